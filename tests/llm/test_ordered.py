"""The Merkle manifest, point-in-time features and coded token ids: brute force, SQL, round trips and awkward rows."""

import hashlib
import random
import zlib
from datetime import datetime, timedelta
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import features, merkle, queries, tokens
from tessera.llm.common import table
from tessera.llm.ordered import ranked

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, rank int"
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(1, None, None, None, None, "x", 1), (2, "", "en", "a", 0, "x", 1), (4, "a\nb", "en", None, 1, "x", 1), (4, "a\nb", "en", None, 1, "x", 1), (4, "c", "en", "a", 1, "x", 1), (None, "a\nb c", "en", "b", 1, "x", 1), (5, "lang\n" * 40_000, "en", "c", 1, "x", 1), (6, "😀 é <|endoftext|> x", "en", "c", 1, "x", 1)]
    return spark.createDataFrame(rows, SCHEMA)


def _sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _plain_manifest(rows):
    """Roots, proofs and folds one node at a time."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: _sha(*map(field, (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([_sha(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
        return out

    def way(levels, at):
        out = []
        for level in levels[:-1]:
            first = at // 3 * 3
            out.append((level[first:at], level[at + 1 : first + 3]))
            at //= 3
        return out

    by, got = {}, []
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        trees[s] = levels([leaf(r, r["text"]) for r in by[s]])
    top = levels([trees[s][-1][0] for s in names])
    for i, s in enumerate(names):
        for j, r in enumerate(by[s]):
            path = way(trees[s], j) + way(top, i)
            changed = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and r["text"] is not None
            node = leaf(r, r["text"].replace("\n", "") if changed else r["text"])
            for left, right in path:
                node = _sha(*left, node, *right)
            got.append((r["doc_id"], trees[s][0][j], trees[s][-1][0], top[-1][0], _sha(*(x for p in path for side in p for x in side)), node, node == top[-1][0]))
    return sorted(got, key=repr)


def _manifest(docs):
    return sorted((tuple(r) for r in merkle.manifest(docs, merkle.lost_breaks()).collect()), key=repr)


def test_manifest_by_brute_force(spark, awkward):
    assert _manifest(awkward) == _plain_manifest([r.asDict() for r in awkward.collect()])
    assert merkle.manifest(awkward.limit(0), merkle.lost_breaks()).count() == 0
    assert _manifest(awkward.limit(1)) == _plain_manifest([r.asDict() for r in awkward.limit(1).collect()])
    # a source of more than a block's nodes, sizes on both sides of powers of three, and many sources
    rows = [(i, f"t{i}\n", "en", "big", i) for i in range(1500)] + [(10_000 + i, "t\nu", None, f"s{i % 40}", None) for i in range(500)] + [(20_000 + i, "v", None, "block", None) for i in range(729)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert _manifest(docs) == _plain_manifest([r.asDict() for r in docs.collect()])


def test_ranks_of_a_hot_group(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, None).otherwise(F.lit("hot")).alias("g"), (F.col("id") * 7919 % 4999).alias("k"))
    got = ranked(rows, "g", ["k"], "at", "n").collect()
    for g in (None, "hot"):
        mine = sorted((r.at, r.k) for r in got if r.g == g)
        assert [a for a, _ in mine] == list(range(len(mine))) and [k for _, k in mine] == sorted(k for _, k in mine) and all(r.n == len(mine) for r in got if r.g == g)


def _features_by_sql(folder_or_frames, sql):
    con = duckdb.connect()
    for name, source in folder_or_frames.items():
        if isinstance(source, str):
            con.sql(f"create view {name} as select * from read_parquet('{source}')")
        else:
            con.register(name, source)
    got = con.sql(sql)
    names = sorted(got.columns)
    return names, sorted((tuple(r[got.columns.index(c)] for c in names) for r in got.fetchall()), key=repr)


@pytest.mark.parametrize("bits", [4, 7, features.PIECE_BITS])
def test_features_by_sql_on_pieces_of_any_size(spark, bits):
    """Small pieces make windows of many blocks, so that the tables above the pieces and their carries are used."""
    got = features.point_in_time(*(table(spark, SF, t) for t in ("clicks", "sales", "sale_lines")), piece_bits=bits)
    names, want = _features_by_sql({t: f"{SF}/{t}.parquet" for t in ("clicks", "sales", "sale_lines")}, queries.oracle_sql()["op13_features"])
    assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=repr) == want


def test_features_of_awkward_rows(spark):
    """Nulls anywhere, repeated and late rows, arrivals before their events, ties, equal items again and again, clashing columns."""
    rng, began = random.Random(5), datetime(2024, 2, 1)
    at = lambda: rng.choice([None, *(began + timedelta(hours=rng.randrange(400), microseconds=rng.randrange(3)) for _ in range(12))])
    ids = lambda n: rng.choice([None, *range(n), *range(n)])
    clicks = [(ids(50), at(), at(), ids(3), rng.choice([None, "purchase", "view"]), rng.choice([None, 1.5, 2.25]), rng.choice([None, "{}"]), 1) for _ in range(400)]
    clicks += clicks[:50]
    sales = [(i % 110 or None, ids(3), "x", rng.choice([None, 0.005, 3.1]), at(), at(), 1, 2) for i in range(120)]
    sales += sales[:3]
    lines = [(ids(120), ids(3), ids(4), 1, 1, rng.choice([None, 2.5]), 0.1, "f", at(), 3) for _ in range(700)]
    frames = {
        "clicks": spark.createDataFrame(clicks, "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string, place int"),
        "sales": spark.createDataFrame(sales, "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int, t int"),
        "sale_lines": spark.createDataFrame(lines, "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, discount double, flag string, shipped_at timestamp_ntz, later int"),
    }
    sql = queries.oracle_sql()["op13_features"]
    names, want = _features_by_sql({k: d.toArrow() for k, d in frames.items()}, sql)
    for bits in (2, 12):
        got = features.point_in_time(*frames.values(), piece_bits=bits)
        rows = sorted((tuple(r[c] for c in names) for r in got.collect()), key=repr)
        assert rows == want
    none = features.point_in_time(*(d.limit(0) for d in frames.values()))
    assert none.count() == 0 and none.columns[:4] == ["sale_id", "d", "t_us", "label"]


def test_id_blocks_round_trip():
    """Blocks of every kind come back; a changed, cut or foreign block is refused."""
    from tessera.llm import idcoder

    rng = np.random.default_rng(3)
    common = rng.zipf(1.3, 20_000) % 49_408
    blocks = [common[i : i + idcoder.BLOCK] for i in range(0, len(common), idcoder.BLOCK)]
    blocks += [np.zeros(0, np.int64), np.array([0]), np.array([49_407] * 4096), rng.permutation(49_408)[:4096], np.tile(rng.integers(0, 49_408, 7), 500), np.array([(1 << 31) - 1, 0])]
    data = idcoder.encode(blocks)
    assert all(np.array_equal(a, b) for a, b in zip(blocks, idcoder.decode(data), strict=True))
    assert [list(idcoder.decode([d]))[0].tolist() for d in data] == [b.tolist() for b in blocks]  # each alone
    assert len(data[-4]) < 64 and len(data[-2]) < 300  # one id, and a period: learnt
    for bad in (b"", data[0][:10], b"XX1" + data[0][3:], data[0][:-40], data[0][:200] + bytes([data[0][200] ^ 1]) + data[0][201:]):
        with pytest.raises(ValueError):
            list(idcoder.decode([bad]))


def _plain_ids(rows):
    """The library's own ids of whole texts."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary("word_bpe_49k.json"))
    return [[*t.encode(r["text"] or "", add_special_tokens=False).ids, tokens.END] for r in rows]


def test_ids_by_the_library(spark, awkward, tmp_path):
    """Whole tables and awkward rows against the tokenizer on whole texts: order, places, counts, checksums and the ids themselves."""
    odd = ["a|b | c||", "É é ́x", "x y z\u0085w\x1cq", "<|startoftext|>|", "ΑΣ ΣΑ Σ", "'s don't |'ll", "\r\n\t", "1234 ١٢", "😀😀 ﬁ Ⅳ"]
    extra = spark.createDataFrame([(100 + i, s, None, None, None, None, None) for i, s in enumerate(odd)], SCHEMA)
    long = spark.createDataFrame([(200, "very long text " * 9000, None, None, None, None, None)], SCHEMA)
    for docs in (awkward.unionByName(extra).unionByName(long), table(spark, "/root/testdata/sf0.001", "documents")):
        folder = tokens.write_ids(docs, tokens.vocabulary("word_bpe_49k.json"))
        rows = sorted((r.asDict() for r in docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["h"]))
        want, start = [], 0
        plain = _plain_ids(rows)
        for r, ids in zip(rows, plain, strict=True):
            want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        got = sorted((tuple(r) for r in tokens.document_digests(spark, folder).collect()), key=lambda r: r[1])
        assert got == want
        back = {}
        for r in tokens.read_ids(spark, folder).orderBy("part", "first").collect():
            back.setdefault((r.part, r["at"]), []).extend(r.ids)
        assert [back[k] for k in sorted(back)] == plain
    none = tokens.write_ids(awkward.limit(0), tokens.vocabulary("word_bpe_49k.json"), str(tmp_path / "none"))
    assert tokens.document_digests(spark, none).count() == 0 and Path(none).exists()


def test_columns_that_clash_but_for_case(spark):
    from tessera.llm import mixing, wumanber

    docs = spark.createDataFrame([(1, "a b c", "s", 5, 1), (2, "d e", "s", 3, 2)], "doc_id long, text string, source string, Repetition long, Hit_Words int")
    sized = mixing.sizes(docs)
    mixed = mixing.mix_texts(docs, mixing.cuts(sized, mixing.targets(sized)))
    assert mixed.columns == [*docs.columns, "repetition_"] and mixed.count() >= 2
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    kept = wumanber.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [2]


def test_passages_of_rows_without_ids(spark):
    """Null or repeated ids give the passages that ids of their own give."""
    from tessera.llm import passages

    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    shared = [[word() for _ in range(70)] for _ in range(4)]
    texts = [" ".join([word() for _ in range(30)] + rng.choice(shared) + [word() for _ in range(30)]) for _ in range(60)]
    places = lambda ids: sorted(tuple(r) for r in passages.find_passages(spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")).select("start", "end", "ref_start", "ref_end", "identity").collect())
    own = places(range(60))
    assert len(own) >= 56 and places([None] * 60) == own == places([7] * 60)


def test_open_seeds_by_brute_force():
    """A seed is open where a run of all shared seeds around it lies in no passage found."""
    from tessera.llm import passages as p

    rng = np.random.default_rng(9)
    for _ in range(200):
        n, size = int(rng.integers(30, 200)), 20
        at = np.unique(rng.integers(0, n - p.K + 1, rng.integers(1, 30))).astype(np.int32)
        reach = p.reaches(at, n)
        some = rng.random(len(at)) < 0.8
        ranges = np.array([(a << 32) + a + int(rng.integers(5, 60)) for a in map(int, rng.integers(0, n, rng.integers(0, 4)))], np.int64)
        got = p.opened(at[some], reach[some], size, ranges)
        shared = set(at[some].tolist())
        inside = lambda x: [s for s in at.tolist() if x <= s and s + p.K <= x + size]
        covered = lambda x: any(r >> 32 <= x and x + size <= r & 0xFFFFFFFF for r in ranges.tolist())
        runs = [x for x in range(n - size + 1) if inside(x) and set(inside(x)) <= shared and not covered(x)]
        want = [any(s in inside(x) for x in runs) for s in at[some].tolist()]
        assert got.tolist() == want


def test_one_long_item_is_searched_in_blocks(spark):
    """A benchmark that is one long text, repeated, beside short ones: blocks stay near their bound, and hits are those of one search."""
    from tessera.llm import wumanber

    rng = random.Random(1)
    words = [rng.choice(["ab", "c", "de", "é"]) + str(rng.randrange(40)) for _ in range(3000)]
    items = [(1, " ".join(words)), (1, " ".join(words)), (2, "ab1 c2"), (3, None), (4, " ".join(words[100:113]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(i, " ".join(["x"] * 5 + words[s : s + 40] + ["y"] * 3)) for i, s in enumerate(range(0, 2960, 37))] + [(900, "c2"), (901, "ab1 c2"), (902, None)], "doc_id long, text string")
    by = lambda n: sorted(map(tuple, wumanber.find_contamination(docs, bench, held_words=n).collect()))
    assert by(400) == by(10**6)
    blocks = wumanber._blocks(bench, "item_id", "text", 400)
    assert len(blocks) > 5 and max(sum(len((r.text or "").split()) for r in b.collect()) for b in blocks) < 1000


def test_equal_passages_of_a_short_period_are_found(spark):
    """Passages of 80 words that repeat every two or three words, most of which hold no seed of its own hash."""
    from tessera.llm import passages

    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = []
    for i in range(40):
        period = [word() for _ in range(2 + i % 2)]
        body = (period * 40)[:80]
        rows += [(2 * i + j, " ".join([word() for _ in range(40)] + body + [word() for _ in range(40)])) for j in range(2)]
    found = passages.find_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    hit = {min(r.doc_id, r.ref_id) // 2 for r in found if {r.doc_id // 2} == {r.ref_id // 2} and r.start <= 45 and r.end >= 115}
    assert len(hit) == 40, len(hit)


def test_short_changed_passages_are_found(spark):
    """Pairs of passages of 55 and 60 words with words replaced at random, and changed passages whose parts stand in other, earlier documents."""
    from tessera.llm import passages

    rng = random.Random(33)
    w = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    rows, pairs = [], {}

    def put(words):
        rows.append((len(rows), " ".join(words)))
        return len(rows) - 1

    for n, changed in ((55, 5), (60, 9), (60, 12)):
        for _ in range(150):
            a = w(n)
            b = list(a)
            for i in rng.sample(range(n), changed):
                b[i] = w(1)[0]
            pairs[put(w(30) + a + w(30)), put(w(45) + b + w(20))] = n, changed
    for _ in range(60):
        a = w(60)
        for i in range(0, 60, 20):
            put(w(30) + a[i : i + 20] + w(30))
        b = list(a)
        for i in rng.sample(range(60), 6):
            b[i] = w(1)[0]
        pairs[put(w(30) + a + w(30)), put(w(45) + b + w(20))] = "parts"
    found = passages.find_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {(min(r.doc_id, r.ref_id), max(r.doc_id, r.ref_id)) for r in found}
    share = {c: sum(p in got for p, x in pairs.items() if x == c) / sum(x == c for x in pairs.values()) for c in set(pairs.values())}
    assert min(share.values()) >= 0.9 and got <= set(pairs), share


def test_meetings_by_brute_force():
    """Anchors and shared places of random places are those of the rule, read word by word."""
    from tessera.llm import passages as p

    rng = np.random.default_rng(5)
    for case in range(300):
        n, asked = int(rng.integers(0, 60)), bool(case % 2)
        h, doc, at = rng.integers(-3, 4, n), rng.integers(-4, 5, n), rng.integers(0, 9, n).astype(np.int32)
        more = np.array([hash((a, b, c)) % 2 for a, b, c in zip(doc.tolist(), at.tolist(), h.tolist(), strict=True)], np.int32)
        held: dict = {}
        for a, d, x, m in sorted(set(zip(h.tolist(), doc.tolist(), at.tolist(), more.tolist(), strict=True))):
            held.setdefault(a, {}).setdefault(d, []).append((x, m))
        pairs, shared = [], []
        for a, docs in held.items():
            if len(docs) < 2 or asked and not any(m for v in docs.values() for _, m in v):
                continue
            names = sorted(docs)
            shared += [(a, d, x) for d in names for x, _ in docs[d]]
            for i, d in enumerate(names):
                others = names[:i] if len(names) <= p.ALL_MEET and not asked else names[: min(i, 1)]
                on = lambda r, k: docs[r][k % len(docs[r])][0]
                pairs += [(d, r, (x << 32) + on(r, k)) for r in others for k, (x, m) in enumerate(docs[d]) if m or not asked]
                if not i:
                    pairs += [(d, names[-1], (x << 32) + on(names[-1], k)) for k, (x, m) in enumerate(docs[d]) if (m if asked else k >= len(docs[names[-1]]))]
        got, rest = p.meetings(h, doc, at, more, asked)
        assert sorted(zip(*(x.tolist() for x in got[:3]), strict=True)) == sorted(pairs)
        assert sorted(zip(*(x.tolist() for x in rest[:3]), strict=True)) == sorted(shared)
