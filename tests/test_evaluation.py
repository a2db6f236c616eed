"""Pair corpora, selections, evidence and text measures on small rows, against plain versions, and queries against SQL."""

import random
import re
from datetime import date
from itertools import combinations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import costs, quality
from tessera.operators import cells, corpora, evidence, linking, pairing, selection
from tessera.plans import evaluation
from tessera.plans.substrate import Substrate, gold_ways, ways


def test_candidate_pairs_are_the_first_of_all_pairs(spark):
    rows = [("k", p, d) for p, d in enumerate("ccctcctttcttcccccctc")] + [("j", p, "c") for p in range(9)] + [("i", 1, "t"), ("i", 2, "c"), ("i", 3, "c")]
    acc = spark.createDataFrame([(k, p, [d]) for k, p, d in rows] + [("k", 90, ["c", "t"])], "key string, paper_id long, directions array<string>")
    want = set()
    for key in "kji":
        mine = sorted((p, d) for k, p, d in rows if k == key)
        pairs = [(a, b, "agreement" if x == y else "contradiction") for (a, x), (b, y) in combinations(mine, 2)]
        for label in ("agreement", "contradiction"):
            want |= {(key, *p) for p in [p for p in pairs if p[2] == label][:4]}
    assert {(r.key, r.paper_a, r.paper_b, r.label) for r in corpora.candidate_pairs(acc).collect()} == want


def test_hard_negatives_share_no_key(spark):
    r = spark.createDataFrame([(1, "C", "D"), (2, "C", "E"), (3, "C", "D"), (4, "B", "D")], "paper_id long, chemical_id string, disease_id string").withColumn("key", F.concat_ws("|", "chemical_id", "disease_id"))
    assert {(x.endpoint, x.paper_a, x.paper_b) for x in corpora.hard_negatives(r).collect()} == {("C", 1, 2), ("C", 2, 3)}


def test_hard_negatives_walk_past_papers_that_share_keys(spark):
    import random

    rng = random.Random(3)
    rows = [(p, "C", "D") for p in range(30)] + [(30, "C", "E"), (31, "C", "F"), (2, "B", "D")] + [(rng.randrange(60), rng.choice("XYZ"), rng.choice("DEFGH")) for _ in range(150)]
    r = spark.createDataFrame(sorted(set(rows)), "paper_id long, chemical_id string, disease_id string").withColumn("key", F.concat_ws("|", "chemical_id", "disease_id"))
    keys = {}
    for p, c, d in rows:
        keys.setdefault(p, set()).add((c, d))
    for at, column in ((1, "chemical_id"), (2, "disease_id")):
        want = set()
        for e in {x[at] for x in rows}:
            papers = sorted({x[0] for x in rows if x[at] == e})
            want |= {(e, a, b) for a, b in [(a, b) for a, b in combinations(papers, 2) if not keys[a] & keys[b]][:4]}
        assert {(x.endpoint, x.paper_a, x.paper_b) for x in corpora.hard_negatives(r, column).collect()} == want
    assert corpora.hard_negatives(r.limit(0)).count() == 0


def test_violations_are_found(spark):
    acc = spark.createDataFrame([("k", 1, ["c"]), ("k", 2, ["t"]), ("k", 3, ["c", "t"])], "key string, paper_id long, directions array<string>")
    pairs = spark.createDataFrame([("k", 1, 2, "contradiction"), ("k", 1, 2, "agreement"), ("k", 2, 1, "contradiction"), ("k", 1, 3, "agreement"), ("j", 1, 2, "agreement")], "key string, paper_a long, paper_b long, label string")
    assert sorted(map(tuple, corpora.pair_violations(pairs, acc).collect())) == [("j", 1, 2), ("k", 1, 2), ("k", 1, 3), ("k", 2, 1)]
    papers = spark.createDataFrame([(1, "One. Two."), (2, "x")], "paper_id long, abstract string")
    found = spark.createDataFrame([(1, 0, 0, 4, "One."), (1, 1, 4, 9, "Two."), (9, 0, 0, 1, "x")], "paper_id long, sentence_index int, start int, end int, text string")
    assert sorted(map(tuple, evidence.not_verbatim(found, papers).collect())) == [(1, 1), (9, 0)]
    documents = spark.createDataFrame([(1, "One. Two."), (3, "y")], "paper_id long, text string")
    assert sorted(map(tuple, evidence.paper_document_mismatches(papers, documents).collect())) == [(2, "missing"), (3, "extra")]
    with pytest.raises(ValueError, match="2 missing, 3 extra"):
        evidence.assert_papers_match_documents(papers, documents)
    evidence.assert_papers_match_documents(papers, papers.withColumnRenamed("abstract", "text"))


def test_greedy_batch_reads_on_until_its_quota_is_filled(spark):
    pool = spark.createDataFrame([(0 if i % 50 else i, i, "x") for i in range(1, 400)], "a long, b long, label string")
    got = corpora.greedy_batch(pool, "label", {"x": 8}, {("a",): 1}, "s", ["a", "b"]).collect()
    assert len(got) == 8 and len({r.a for r in got}) == 8


def _defined(text):
    """The definitions of one text, word by word."""
    import re

    out, words = {}, re.compile("[A-Za-z0-9][A-Za-z0-9-]*")
    for m in re.finditer(r"\(([^()]{2,15})\)", text):
        short, before = m[1].strip(), text[: m.start()].rstrip()
        letters = [c for c in short.lower() if c.isalnum()]
        if short in out or not re.fullmatch(r"\S{2,10}", short) or not short[0].isalnum() or not any(c.isalpha() for c in short):
            continue
        for at in [w.start() for w in words.finditer(before)][: -len(short) - 6 : -1]:
            if re.match(".*?".join(map(re.escape, letters)), before[at:].lower(), re.S):
                out[short] = before[at:]
                break
    return out


def _abbreviations(spark, texts):
    got = {i: {} for i in range(len(texts))}
    rows = spark.createDataFrame(list(enumerate(texts)), "paper_id long, abstract string")
    for r in evidence.abbreviations(rows).collect():
        got[r.paper_id][r.short] = r.long
    return [got[i] for i in range(len(texts))]


def test_abbreviations(spark):
    long = "x" * 3000
    cases = {
        f"a {long} method named polymerase chain reaction (PCR) works": {"PCR": "polymerase chain reaction"},
        f"p{long} chain reaction (PCR)": {"PCR": f"p{long} chain reaction"},
        "tumor necrosis factor (TNF), again total nonsense first (TNF)": {"TNF": "tumor necrosis factor"},
        "one two three four five six seven eight polymer nine ten eleven twelve thirteen fourteen chain rest (PCR)": {},
        "Polycystic ovary syndrome (PCOS) and polycystic ovaries (PCOS)": {"PCOS": "Polycystic ovary syndrome"},
        "no definition (XY)": {},
        "tumour necrosis factor (TNF-a) (n = 5) (12)": {"TNF-a": "tumour necrosis factor"},
        "tumour necrosis factor alpha (TNF-a)": {"TNF-a": "tumour necrosis factor alpha"},
        "": {},
        "(AB)": {},
        "an -odd- --case a-b- c\n (AC) (ab) é (éa)": None,
    }
    texts = list(cases)
    got = _abbreviations(spark, texts)
    assert all(g == (_defined(t) if cases[t] is None else cases[t]) == _defined(t) for t, g in zip(texts, got, strict=True))
    rng = random.Random(8)
    bits = ["a", "b", "ab", "ba-", "-c", "(ab)", "(a-b)", "(ba c)", " ", " ", "--", ".", "\n", "C1", "(1a)", "é", "(", ")"]
    texts = ["".join(rng.choice(bits) for _ in range(60)) for _ in range(400)]
    assert _abbreviations(spark, texts) == [_defined(t) for t in texts]
    assert evidence.abbreviations(spark.createDataFrame([(1, None)], "paper_id long, abstract string")).count() == 0


def test_positions_number_a_total_order(spark):
    rows = spark.createDataFrame([(f"k{(i * 37) % 500:03d}",) for i in range(500)], "key string").repartition(7)
    got = evidence.positions(rows, ["key"]).collect()
    assert {(r.key, r.position) for r in got} == {(f"k{i:03d}", i + 1) for i in range(500)}


def test_viewer_checks(spark, tmp_path):
    from tessera.operators import viewer

    files = spark.createDataFrame([("index.html", '<a href="/b/runs/x/">x</a> <a href="#top">t</a> <p id="here"> <a href="https://e.org/">e</a> <img src="no.png">'), ("runs/x/index.html", '<a href="../../index.html#here">h</a> <a href="../y/">y</a> <a href="/other/">o</a> <a href="../../index.html#gone">g</a>'), ("a.css", "x")], "path string, text string")
    assert sorted(map(tuple, viewer.broken_links(files, "/b/").collect())) == [("index.html", "#top", "no such id"), ("index.html", "no.png", "no such file"), ("runs/x/index.html", "../../index.html#gone", "no such id"), ("runs/x/index.html", "../y/", "no such file"), ("runs/x/index.html", "/other/", "outside the base path")]
    anchors = spark.createDataFrame([("stage:extract/dropped/no_text",), ("stage:extract/dropped/other",), ("cluster:A|B",), ("cluster:A|C",), ("nonsense",)], "anchor string")
    ledger, clusters = spark.createDataFrame([("extract", "no_text")], "stage string, reason string"), spark.createDataFrame([("A|B",)], "key string")
    assert sorted(r.anchor for r in viewer.unresolved_anchors(anchors, ledger, clusters).collect()) == ["cluster:A|C", "nonsense", "stage:extract/dropped/other"]
    papers = spark.createDataFrame([(1, True, "https://creativecommons.org/licenses/by/4.0/"), (2, True, None), (3, False, None), (4, True, "https://e.org")], "paper_id long, excerpted boolean, license_url string")
    assert sorted(r.paper_id for r in viewer.unattributable_excerpts(papers).collect()) == [2, 4]
    (tmp_path / "one.json").write_text('{"schema_version": 2, "slug": "one", "clusters": ["a"], "stages": []}')
    assert [r.slug for r in viewer.load_runs(spark, str(tmp_path), 2).collect()] == ["one"]
    runs, notes = spark.createDataFrame([("one",)], "slug string"), spark.createDataFrame([("two",)], "slug string")
    assert sorted(map(tuple, viewer.unmatched_notes(runs, notes).collect())) == [("one", "left"), ("two", "right")]
    with pytest.raises(Exception, match="schema version"):
        viewer.load_runs(spark, str(tmp_path), 3).collect()
    (tmp_path / "two.json").write_text('{"schema_version": 2, "slug": "three", "clusters": [], "stages": []}')
    with pytest.raises(Exception, match="slug"):
        viewer.load_runs(spark, str(tmp_path), 2).collect()
    assert viewer.provenance({"a": 1, "b": 2}, "v", date(2026, 1, 1)) == viewer.provenance({"b": 2, "a": 1}, "v", date(2026, 1, 1)) != viewer.provenance({"a": 1}, "v", date(2026, 1, 1))


def test_judges(spark):
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 4)], "paper_a long, paper_b long")
    texts = spark.createDataFrame([(1, "Harm caused by x"), (2, "therapy"), (3, "caused, induced by"), (4, None)], "paper_id long, abstract string")
    concepts = spark.createDataFrame([(1, "A"), (3, "A"), (2, "B")], "paper_id long, canonical_id string")
    got = {(r.paper_a, r.paper_b): (r.lexicon, r.overlap) for r in corpora.judged(pairs, texts, concepts).collect()}
    assert got == {(1, 2): ("contradiction", "insufficient_overlap"), (1, 3): ("agreement", "agreement"), (2, 4): ("insufficient_overlap", "insufficient_overlap")}


def test_signals(spark):
    rows = spark.createDataFrame([("Does metformin help women?", "metformin in Korean women", "metformin in men"), ("Does metformin help?", "metformin", "aspirin"), ("Does metformin help?", "Metformin", "metformin")], "q string, a string, b string")
    got = [r.s for r in rows.select(corpora.pair_signals(F.col("q"), F.col("a"), F.col("b")).alias("s")).collect()]
    assert got == [["population_mismatch"], ["off_question"], []]


def test_greedy_batch_honours_caps_and_raises_when_short(spark):
    pool = spark.createDataFrame([(a, b, f"k{(a * b) % 5}", "x" if (a + b) % 2 else "y") for a in range(12) for b in range(a + 1, 12)], "a long, b long, key string, label string")
    run = lambda q: corpora.greedy_batch(pool, "label", q, {("a", "b"): 1, ("key",): 2}, "s", ["a", "b"])
    got = run({"x": 2, "y": 2}).collect()
    papers = [v for r in got for v in (r.a, r.b)]
    assert len(got) == 4 and len(set(papers)) == 8 and max(sum(r.key == k for r in got) for k in {r.key for r in got}) <= 2
    assert sorted(got) == sorted(run({"x": 2, "y": 2}).repartition(3).collect())
    with pytest.raises(Exception, match="short of their quota"):
        run({"x": 30, "y": 2}).collect()


def test_greedy_rounds_equal_the_pass_by_rows(spark):
    """Against the sequential pass, over hot values, shared counters, nulls, repeated rows and caps above one."""
    import hashlib

    def plain(rows, quotas, caps):
        draw = lambda r: hashlib.md5("|".join(["s", *(str(r[c]) for c in "ab" if r[c] is not None)]).encode()).hexdigest()
        small = lambda v: (v is not None, v or 0)
        used, count, out = {}, dict.fromkeys(quotas, 0), []
        for r in sorted((r for r in rows if r["label"] in quotas), key=lambda r: (list(quotas).index(r["label"]), draw(r), small(r["a"]), small(r["b"]))):
            wanted = {(c, r[x]) for c in caps for x in c}
            if count[r["label"]] < quotas[r["label"]] and all(used.get(w, 0) < caps[w[0]] for w in wanted):
                count[r["label"]] += 1
                out.append(tuple(r.values()))
                for w in wanted:
                    used[w] = used.get(w, 0) + 1
        return out

    rng = random.Random(4)
    for caps in ({("a", "b"): 1}, {("a", "b"): 2, ("key",): 3}, {("a",): 1, ("b",): 4}):
        pick = lambda n: rng.choice([None, 0, *range(n)])
        rows = [{"a": pick(60), "b": pick(60), "key": f"k{rng.randrange(9)}", "label": rng.choice("xyz")} for _ in range(900)]
        rows += rows[:40]
        pool = spark.createDataFrame([tuple(r.values()) for r in rows], "a long, b long, key string, label string")
        quotas = {"y": 7, "x": 5}
        got = corpora.greedy_batch(pool, "label", quotas, caps, "s", ["a", "b"]).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain(rows, quotas, caps)))


def test_windows_by_doubling_against_the_pass_by_windows(spark):
    """Texts of one to many sentences, words over the budget in one of them, and overlaps of none to several sentences."""
    from tessera.functions.text import sentences
    from tessera.operators.windows import plan, plan_windows

    rng = random.Random(2)
    texts = [" ".join(" ".join("w" * rng.randrange(1, 4) for _ in range(rng.choice([1, 2, 5, 9, 30]))) + "." for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "paper_id long, abstract string")
    cut = sentences(rows)
    spans = {}
    for r in cut.orderBy("paper_id", "sentence_index").collect():
        spans.setdefault(r.paper_id, []).append((r.start, r.end))
    for budget, overlap in ((12, 1), (25, 0), (25, 3), (1, 1)):
        want = sorted((i, n, a, b) for i, t in enumerate(texts) for n, (a, b) in enumerate(plan(t, spans[i], lambda u: len(u.split()), budget, overlap)))
        assert sorted(map(tuple, plan_windows(cut, budget, overlap).collect())) == want
    assert plan_windows(cut.limit(0)).count() == 0


def test_overlaps_by_a_sweep(spark):
    """Against all pairs, with empty, repeated and null spans; then a document of 100,000 spans."""
    from tessera.operators.spans import overlap_counts

    rng = random.Random(3)
    span = lambda: (rng.choice([1, 2, None]), rng.choice("xy"), *sorted((rng.randrange(40), rng.randrange(40))))
    a, b = [span() for _ in range(150)] + [(1, "x", None, 4)], [span() for _ in range(150)] + [(1, "x", 3, None)]
    frame = lambda rows: spark.createDataFrame(rows, "paper_id long, label string, start int, end int")
    hit = lambda p, q: None not in p + q and p[:2] == q[:2] and max(p[2], q[2]) < min(p[3], q[3])
    want = {p: (sum(hit(p, q) for q in b), sum(hit(p, q) and p == q for q in b)) for p in a}
    got = {tuple(r[:4]): (r.n, r.equal) for r in overlap_counts(frame(a), frame(b), ["paper_id", "label"]).collect()}
    assert got == want
    many = spark.range(100_000).select(F.lit(1).alias("paper_id"), F.lit("x").alias("label"), (F.col("id") * 3).alias("start"), (F.col("id") * 3 + 4).alias("end"))
    n = overlap_counts(many, many, ["paper_id", "label"]).groupBy("n", "equal").count().collect()
    assert {tuple(r) for r in n} == {(2, 1, 2), (3, 1, 99_998)}


def test_padding_reaches_the_budget(spark):
    rows = spark.range(500).withColumnRenamed("id", "k")
    base = rows.filter("k < 10")
    for budget in (10, 11, 200, 500):
        got = [r.k for r in selection.pad_to_budget(base, rows, budget, "s", ["k"]).collect()]
        assert len(got) == len(set(got)) == budget and set(range(10)) <= set(got)
    for budget in (9, 501):
        with pytest.raises(ValueError):
            selection.pad_to_budget(base, rows, budget, "s", ["k"])


def test_screen_fills_quotas_first(spark):
    q = spark.createDataFrame([(1, "a", 50), (2, "a", 40), (3, "b", 9), (4, "b", 7), (5, "a", 30)], "query_id long, stratum string, n_clusters long")
    assert [r.query_id for r in selection.screen(q, 3, {"b": 2}).collect()] == [1, 2, 3]


def test_inversions_against_all_pairs(spark):
    tiers = ["background", "answers", None, "off_topic", "answers", "background", "answers"]
    got = selection.inversions(spark.createDataFrame([(1, i, t) for i, t in enumerate(tiers)], "query_id long, rank long, tier string")).first()
    at = [selection.TIERS.index(t) for t in tiers if t]
    assert (got.pairs, got.inverted) == (sum(x != y for x, y in combinations(at, 2)), sum(x > y for x, y in combinations(at, 2)))


def test_distribution_refuses_few_draws(spark):
    with pytest.raises(Exception, match="fewer than 200 draws"):
        selection.distribution(spark.range(5).select(F.col("id").cast("double").alias("v")), "v").collect()


def test_pairs_of_a_paper_are_made_once(spark):
    rows = [(1, "CHEMICAL", "A"), (1, "CHEMICAL", "A"), (1, "DISEASE", "D"), (1, "DISEASE", "E"), (2, "CHEMICAL", "A"), (2, "DISEASE", None), (3, "DISEASE", "D"), (4, "CHEMICAL", "A"), (4, "DISEASE", "A"), (None, "CHEMICAL", "A"), (None, "DISEASE", "D")]
    pairs = pairing.cross_pairs(spark.createDataFrame(rows, "paper_id long, label string, canonical_id string"))
    assert sorted(tuple(r) for r in pairs.collect()) == [(1, "A", "D"), (1, "A", "E"), (4, "A", "A")]
    # both sides are distinct, so the product isn't aggregated again
    assert "Aggregate" not in pairs._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]


def test_relations_outside_cross_pairs(spark):
    linked = spark.createDataFrame([(1, "CHEMICAL", "A"), (1, "DISEASE", "D"), (2, "CHEMICAL", "A"), (2, "DISEASE", None), (3, "DISEASE", "A"), (3, "DISEASE", "D"), (None, "CHEMICAL", "A"), (None, "DISEASE", "D")], "paper_id long, label string, canonical_id string")
    relations = spark.createDataFrame([(1, "A", "D"), (1, "A", "E"), (1, "B", "D"), (1, "B", "E"), (2, "A", "D"), (3, "A", "D"), (4, "A", "D"), (None, "A", "D"), (1, None, "D"), (1, "A", "E")], "paper_id long, chemical_id string, disease_id string")
    want = relations.join(pairing.cross_pairs(linked), ["paper_id", "chemical_id", "disease_id"], "left_anti")
    found = pairing.outside_cross_pairs(relations, linked)
    assert sorted(map(str, (tuple(r) for r in found.collect()))) == sorted(map(str, (tuple(r) for r in want.collect()))) and found.count() == 9


def test_clusters_are_dealt_by_key_once(spark):
    pairs = spark.createDataFrame([(p, f"C{p % 3}", "D") for p in range(7)] * 2 + [(1, "X", "Y")], "paper_id long, chemical_id string, disease_id string")
    clusters = pairing.cluster_papers(pairs)
    assert sorted((r.chemical_id, r.n_papers, tuple(r.paper_ids)) for r in clusters.collect()) == [("C0", 3, (0, 3, 6)), ("C1", 2, (1, 4)), ("C2", 2, (2, 5))]
    plan = clusters._jdf.queryExecution().sparkPlan().toString() + clusters._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(paper_id" not in plan and "ENSURE_REQUIREMENTS" not in plan.split("BroadcastExchange")[0]


def test_gold_sentences_need_no_pairs_of_other_sentences(spark, small):
    s = Substrate(spark, small)
    few, every = evaluation._gold(s), selection.gold_sentences(s.gold_relations, s.located)
    assert sorted(tuple(r) for r in few.collect()) == sorted(tuple(r) for r in every.collect()) != []
    assert s.gold_among(s.pairs).count() < s.gold_relations.count()


def test_directions_as_arrays_are_rows_of_their_own(spark):
    rows = spark.createDataFrame([(1, "k", ["treats", "causes", "causes"]), (2, "k", ["causes"])], "paper_id long, key string, directions array<string>")
    one = rows.select("paper_id", "key", F.explode("directions").alias("direction"))
    found = [sorted((r.paper_id, r.key, tuple(r.directions)) for r in corpora.accumulate_directions(x).collect()) for x in (rows, one)]
    assert found[0] == found[1] == [(1, "k", ("causes", "treats")), (2, "k", ("causes",))]


def test_overlap_by_a_likely_concept_and_by_all(spark):
    pairs = spark.createDataFrame([("C|D", 1, 2), ("C|D", 1, 3), ("X|D", 2, 3), ("C|E", 1, 4), ("N|E", 3, 4)], "key string, paper_a long, paper_b long")
    concepts = spark.createDataFrame([(1, "C"), (2, "C"), (2, "Z"), (3, "Z"), (3, "C"), (4, "Q")], "paper_id long, canonical_id string")
    texts = spark.createDataFrame([(1, "caused by"), (2, "therapy"), (3, None)], "paper_id long, abstract string")
    verdicts = [sorted(tuple(r) for r in corpora.judged(pairs, texts, concepts, likely=x).collect()) for x in (None, F.substring_index("key", "|", 1))]
    assert verdicts[0] == verdicts[1]
    assert {(r[1], r[2]): r[-1] for r in verdicts[1]} == {(1, 2): "agreement", (1, 3): "agreement", (2, 3): "agreement", (1, 4): "insufficient_overlap", (3, 4): "insufficient_overlap"}


def test_greedy_batches_go_beyond_the_first_rows_where_these_fall_short(spark):
    rng = random.Random(5)
    rows = [(f"k{rng.randrange(9)}", rng.randrange(12), rng.randrange(12, 24), rng.choice("xy")) for _ in range(300)]
    pool = spark.createDataFrame(sorted(set(rows)), "key string, paper_a long, paper_b long, label string")
    taken = [sorted(tuple(r) for r in corpora.greedy_batch(pool, "label", {"x": 4, "y": 3}, {("paper_a", "paper_b"): 1, ("key",): 1}, "s", ["key", "paper_a", "paper_b"], ahead=n).collect()) for n in (1, 1000)]
    assert taken[0] == taken[1] and len(taken[0]) == 7


def test_unmatched_and_upsert(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string"), spark.createDataFrame([(2, "z"), (3, "w")], "k long, v string")
    assert {(r.k, r.side) for r in selection.unmatched(a, b, ["k"]).collect()} == {(1, "left"), (3, "right")}
    assert {(r.k, r.v) for r in selection.upsert(a, b, ["k"]).collect()} == {(1, "x"), (2, "z"), (3, "w")}


def test_folding_and_words(spark):
    r = spark.createDataFrame([("Café TNF-α—x -ab- IL‐6",)], "t string").select(quality.alias_words(quality.fold(F.col("t"))).alias("w")).first()
    assert r.w == ["cafe", "tnf-alpha-x", "ab", "il-6"]
    g = spark.createDataFrame([(["a", "b", "c"],), ([],)], "w array<string>").select(quality.ngrams(F.col("w"), 2).alias("g")).collect()
    assert [x.g for x in g] == [["a", "b", "c", "a b", "b c"], []]


def test_concepts_of_outputs_and_sources(spark):
    aliases = spark.createDataFrame([("Alpha", "A"), ("alpha beta", "AB"), ("beta", "B"), ("b", "B"), ("x y z", "XYZ"), ("x", "X"), ("a b c d e f g", "LONG")], "alias_key string, concept_id string").withColumns({"is_preferred": F.lit(True), "ord": F.lit(0)})
    texts = [(1, "alpha, Beta! x y", "alpha x"), (2, "x y x y z", "y z"), (3, "beta", "b"), (4, None, "alpha"), (5, "alpha", None), (6, "a b c d e f g x y z", "x y z"), (6, "alpha", ""), (7, "", "")]
    named = {"A": ["alpha"], "AB": ["alpha beta"], "B": ["beta", "b"], "XYZ": ["x y z"], "X": ["x"]}

    def plain(text: str | None) -> set[str]:
        words = " " + " ".join("".join(c if c.isalnum() else " " for c in (text or "").lower()).split()) + " "
        return {c for c, names in named.items() if any(f" {n} " in words for n in names)}

    rows = spark.createDataFrame(texts, "paper_id long, o string, s string")
    of = lambda at: {(t[0], c) for t in texts for c in plain(t[at])}
    pairs = lambda df: sorted((r.paper_id, r.concept_id) for r in df.collect())
    assert pairs(evidence.text_concepts(rows, aliases, "o")) == sorted(of(1))
    assert pairs(evidence.unsourced_concepts(rows, aliases, "o", "s")) == sorted(of(1) - of(2))


def test_judging_words_are_given_by_their_neighbours(spark):
    rows = spark.createDataFrame([("Results are consistent with x", "consistent with y"), ("findings are consistent across studies", "consistent with y"), ("Concurrent use; mixed", ""), ("", "a")], "o string, s string")
    assert [r.v for r in rows.select(quality.judgement_volunteered(F.col("o"), F.col("s")).alias("v")).collect()] == [[], ["consistent"], ["mixed"], []]


def test_context_windows_end_at_spaces(spark):
    t = "alpha beta gamma delta epsilon"
    rows = spark.createDataFrame([(t, 11, 16)], "t string, s int, e int")
    cut = lambda n: rows.select(quality.context_window(F.col("t"), F.col("s"), F.col("e"), n).alias("w")).first().w
    assert [cut(0), cut(2), cut(200)] == ["gamma", "beta gamma delta", t]


def test_support_and_moments(spark):
    ok, bad = quality.supported(F.array(F.lit("1"), F.lit("7"), F.lit("9"), F.lit("9")), F.array(F.lit("1")), F.lit(7))
    r = spark.range(1).select(ok.alias("ok"), bad.alias("bad")).first()
    assert (r.ok, r.bad) == (2, ["9", "9"])
    mean, sd = quality.recall_when_padded(*[F.lit(float(x)) for x in (3, 10, 50, 10, 50)])
    r = spark.range(1).select(mean.alias("m"), sd.alias("s")).first()
    assert (r.m, r.s) == (1.0, 0.0)


def test_costs():
    assert abs(costs.t_quantile(0.975, 10) - 2.228) < 0.01 and costs.split_evenly(7, 3) == [3, 2, 2]
    table = {"m": {"in": 3.0}}
    assert costs.prices(table, "m", date(2026, 1, 1), date(2026, 1, 31)) == {"in": 3e-06}
    for model, today in (("x", date(2026, 1, 2)), ("m", date(2026, 3, 1))):
        with pytest.raises(ValueError):
            costs.prices(table, model, date(2026, 1, 1), today)


def test_document_checks(spark):
    long = "A sentence of some length that goes on. " * 4
    papers = spark.createDataFrame([(1, long), (2, long), (3, "short. X"), (4, "x" * 120), (5, long)], "paper_id long, abstract string")
    e = spark.createDataFrame([(1, "sentence", 2, 10), (2, "sentence", 3, 11), (5, "a", 900, 901)], "paper_id long, text string, start int, end int")
    assert {r.paper_id: r.verdict for r in evidence.document_context(papers, e).collect()} == {1: "ok", 2: "surface_mismatch", 3: "too_short", 4: "no_sentence_break", 5: "out_of_bounds"}


@pytest.mark.parametrize("name", ["a18_directions", "j13_candidate_pairs", "j13_hard_negatives", "f22_judges", "p15_pair_signals", "a26_selection_scores", "r5_pad_to_budget", "a19_mention_evidence", "p6_document_context", "f14_distinguishing_tokens", "f9_text_concepts"])
def test_queries_against_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    got = evaluation.queries()[name](spark, small)
    cols = sorted(got.columns)
    mine = sorted(str(tuple(r[c] for c in cols)) for r in got.collect())
    theirs = sorted(str(tuple(r)) for r in con.execute(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from ({evaluation.oracle_sql()[name]})").fetchall())
    assert mine == theirs


def test_an_id_that_is_chemical_and_disease_is_two_endpoints(spark, tmp_path):
    # ththesin is a chemical and theareti a disease, both by the id MESH:5EB5AB
    texts = [(i, f"ththesin {('laaipaçre', 'aielletionê', 'toanerorea')[i % 3]}" if i % 2 else f"{('thedonnt', 'keitbege', 'eredatth')[i % 3]} theareti") for i in range(60)]
    spark.createDataFrame(texts, "doc_id long, text string").withColumn("source", F.lit("s")).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in evaluation.queries()["j13_hard_negatives"](spark, str(tmp_path)).select("endpoint", "paper_a", "paper_b").collect())
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.execute(evaluation.oracle_sql()["j13_hard_negatives"]).fetchall())
    assert sum(r[0] == "MESH:5EB5AB" for r in got) == 8


def _rows_moved(spark, make):
    """Rows of a result and the number of rows that its shuffles wrote."""
    store = spark.sparkContext._jsc.sc().statusStore()
    quantiles = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def total():
        stages = store.stageList(None, False, False, quantiles, None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()) if stages.apply(i).stageId() > last)

    stages = store.stageList(None, False, False, quantiles, None)
    last = max((stages.apply(i).stageId() for i in range(stages.size())), default=-1)
    return make().collect(), total()


def _distinguished(members, words):
    """By plain sets, from ``key, paper_id`` and the tokens of each paper that has findings."""
    out = {}
    for key, p in members:
        others = set().union(*(words.get(q, set()) for k, q in members if k == key and q != p))
        n = len(words.get(p, set()) - others)
        out[key, p] = (n, "scorable" if n else "indistinguishable" if p in words else "no_findings")
    return out


@pytest.mark.parametrize("block", [2_048, 2])
def test_distinguishing_tokens_by_sets_of_papers(spark, monkeypatch, block):
    monkeypatch.setattr(evidence, "SET_BLOCK", block)
    rng = random.Random(5)
    texts = {p: [rng.choice(["word", "other", "ab"]) + str(rng.randrange(40)) for _ in range(rng.randrange(1, 30))] for p in range(12)} | {12: ["a", "be"], 13: ["word1", "word1"]}
    members = sorted({(f"k{rng.randrange(12)}", rng.randrange(15)) for _ in range(90)}) + [(f"same{i}", p) for i in range(5) for p in (1, 2, 12)]
    m, f = spark.createDataFrame(members, "key string, paper_id long"), spark.createDataFrame([(p, " ".join(w)) for p, w in texts.items()], "paper_id long, text string")
    got = {(r.key, r.paper_id): (r.n_tokens, r.category) for r in evidence.distinguishing_tokens(m, f).collect()}
    assert got == _distinguished(members, {p: {x for x in w if len(x) >= 4} for p, w in texts.items()})


def test_keys_of_one_set_of_papers_move_their_tokens_once(spark):
    texts = {p: {f"word{i}" for i in range(p, 300 + p)} for p in range(3)}
    members = [(f"k{i}", p) for i in range(300) for p in range(3)]
    m, f = spark.createDataFrame(members, "key string, paper_id long"), spark.createDataFrame([(p, " ".join(sorted(w))) for p, w in texts.items()], "paper_id long, text string")
    got, moved = _rows_moved(spark, lambda: evidence.distinguishing_tokens(m, f))
    assert {(r.key, r.paper_id): (r.n_tokens, r.category) for r in got} == _distinguished(members, texts)
    assert moved < 30_000  # 900 members of 300 tokens are 270,000 rows


def test_all_pairs_of_a_paper_are_scored_without_moving_them(spark):
    located = spark.createDataFrame([(p, s, label, f"{label[0]}{i}") for p in range(2) for label in ("CHEMICAL", "DISEASE") for i in range(200) for s in (i, 64 + (i + p) % 70)], "paper_id long, sentence_index int, label string, canonical_id string")
    rows = pairing.placed_pairs(located)
    gold, early = F.substring("disease_id", -1, 1) < "5", F.col("chemical_id") < "C15"
    got, moved = _rows_moved(spark, lambda: selection.granted_scores(rows, gold, pairing.together(), {"early": gold & early}))
    assert moved < 5_000  # 80,000 pairs
    pairs = {tuple(r) for r in pairing.same_sentence_pairs(located).collect()}
    every = {tuple(r) for r in pairing.cross_pairs(located).collect()}
    is_gold = {x for x in every if x[2][-1] < "5"}
    for r in got:
        p = pairs | ({x for x in is_gold if x[1] < "C15"} if r.variant == "early" else set())
        assert (r.tp, r.fp, r.fn) == (len(p & is_gold), len(p - is_gold), len(is_gold - p))
    assert {r.variant for r in got} == {"none", "early"}


def test_a_concept_that_is_chemical_and_disease_counts_all_its_sentences(spark):
    located = spark.createDataFrame([(1, 0, "CHEMICAL", "A"), (1, 1, "DISEASE", "A"), (1, 2, "DISEASE", "B"), (1, 0, "CHEMICAL", None)], "paper_id long, sentence_index int, label string, canonical_id string")
    got = {(r.chemical_id, r.disease_id): (r.n_chemical, r.n_disease, r.t) for r in pairing.placed_pairs(located).withColumn("t", pairing.together()).collect()}
    assert got == {("A", "A"): (2, 2, False), ("A", "B"): (2, 1, False)}


def test_fragments_are_merged_in_one_pass_over_the_texts(spark):
    texts = spark.createDataFrame([(1, "N-methyl and co/factor-x, pre- post"), (2, None), (3, ""), (4, "plain words only"), (5, "a–b " * 500)], "paper_id long, abstract string")
    words = lambda t: ((i, m[0], "C", m.start(), m.end()) for i, m in enumerate(re.finditer("[a-zA-Z]+", t)))
    got, moved = _rows_moved(spark, lambda: linking.merge_found(texts, words))
    mentions = spark.createDataFrame([(p, *m) for p, t in ((r.paper_id, r.abstract) for r in texts.collect()) if t for m in words(t)], "paper_id long, ord int, text string, label string, start int, end int")
    assert sorted(map(str, got)) == sorted(map(str, linking.merge_fragments(mentions, texts).collect()))
    assert [(r.start, r.end, r.text, r.n_parts) for r in sorted(got, key=lambda r: (r.paper_id, r.run))][:2] == [(0, 8, "N-methyl", 2), (13, 24, "co/factor-x", 3)]
    assert len(got) == 502 and not moved


def test_pooled_relations_are_not_moved(spark):
    rows = [(p, c, d) for p in range(20) for c in range(10) for d in range(10)]
    relations = spark.createDataFrame([(p, f"C{c}", f"D{d}") for p, c, d in rows if d < 5], "paper_id long, chemical_id string, disease_id string")
    members = spark.createDataFrame([(p, f"C{c}", f"D{d}") for p, c, d in rows if c == d], relations.schema)
    got, moved = _rows_moved(spark, lambda: pairing.pooled_rows(relations, members, F.col("disease_id") < "D5"))
    assert sorted((r.paper_id, r.chemical_id, r.disease_id) for r in got) == sorted((p, f"C{c}", f"D{d}") for p, c, d in rows if d < 5 or c == d)
    assert not moved


def test_pooled_members_deal_no_gold_by_key(spark, small):
    got, moved = _rows_moved(spark, lambda: evaluation.queries()["u4_pooled_members"](spark, small))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{small}/documents.parquet'")
    theirs = con.execute(f"select chemical_id, disease_id, paper_id from ({evaluation.oracle_sql()['u4_pooled_members']})").fetchall()
    assert sorted((r.chemical_id, r.disease_id, r.paper_id) for r in got) == sorted(theirs)
    assert moved < 5 * Substrate(spark, small).found.count()


def test_digests_of_many_texts_equal_those_of_each():
    import hashlib

    from tessera.functions import digests

    rng = np.random.default_rng(2)
    for size in (0, 1, 31, 55):
        texts = rng.integers(0, 256, (digests.CHUNK + 9, size)).astype(np.uint8)
        assert digests.first_digits(texts).tolist() == [int(hashlib.md5(x.tobytes()).hexdigest()[0], 16) for x in texts]
    with pytest.raises(ValueError):
        digests.first_digits(np.zeros((1, 56), np.uint8))


def test_gold_by_arrays_is_gold_by_rows(spark):
    rng = np.random.default_rng(3)
    paper = np.concatenate([rng.integers(0, 10**k, 200) for k in range(1, 19)] + [rng.integers(-(10**6), 0, 100)])
    c, d = rng.integers(0, 1 << 24, (2, len(paper))).astype(np.int32)
    rows = spark.createDataFrame([*zip(paper.tolist(), c.tolist(), d.tolist(), gold_ways(paper, c, d).tolist(), strict=True)], "paper_id long, c int, d int, ways int")
    named = rows.select("paper_id", "ways", Substrate.concept_name(F.col("c")).alias("chemical_id"), Substrate.concept_name(F.col("d")).alias("disease_id"))
    by_row = F.when(~Substrate.is_gold(), 0).when(F.size(ways()) == 2, 3).when(ways()[0] == "causes", 1).otherwise(2)
    assert named.filter(by_row != F.col("ways")).count() == 0 and named.filter("ways > 0").count() > 1_000


@pytest.mark.parametrize("most", [2_000_000, 7])
def test_candidate_pairs_in_cells_are_those_of_all_relations(spark, most):
    """Pairs, facts and directions of relations made in cells, and nothing but papers' concepts is dealt."""
    rng = random.Random(8)
    own = {p: (rng.sample(range(40), rng.randrange(0, 30)), rng.sample(range(30), rng.randrange(0, 25))) for p in range(-3, 60)} | {10**12: (list(range(40)), list(range(30)))}
    rule = lambda p, c, d: ((p * 7 + c * 5 + d * 3) % 11 % 4).astype(np.uint8)
    papers = spark.createDataFrame([(p, None if p == 5 else f"fact {p}", c, d) for p, (c, d) in own.items()], "paper_id long, fact string, lefts array<int>, rights array<int>")
    sides = {0: [], 1: ["causes"], 2: ["treats"], 3: ["causes", "treats"]}
    rows = [(f"{c}|{d}", p, sides[(p * 7 + c * 5 + d * 3) % 11 % 4]) for p, (cs, ds) in own.items() for c in cs for d in ds]
    told = {(k, p): d for k, p, d in rows}
    acc = spark.createDataFrame([r for r in rows if r[2]], "key string, paper_id long, directions array<string>")
    want = {tuple(r) for r in corpora.candidate_pairs(acc).select("key", "paper_a", "paper_b", "label").collect()}
    got, moved = _rows_moved(spark, lambda: cells.candidate_pairs(papers, rule, most=most))
    assert {(f"{r.left}|{r.right}", r.paper_a, r.paper_b, "agreement" if r.agree else "contradiction") for r in got} == want and len(got) == len(want)
    for r in got:
        assert (r.fact_a, r.fact_b) == tuple(None if p == 5 else f"fact {p}" for p in (r.paper_a, r.paper_b))
        assert (sides[r.ways_a], sides[r.ways_b]) == tuple(told[f"{r.left}|{r.right}", p] for p in (r.paper_a, r.paper_b))
    assert moved < 600 < len(rows)  # a row a cell and batch of papers
    assert cells.candidate_pairs(papers.limit(0), rule).count() == 0


@pytest.mark.parametrize("name", ["p16_usable_pairs", "f32_pair_ids", "r1_greedy_pairs", "v1_pair_violations", "j13_candidate_pairs", "f22_judges"])
def test_queries_of_pairs_deal_no_relation(spark, small, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{small}/documents.parquet'")
    got, moved = _rows_moved(spark, lambda: evaluation.queries()[name](spark, small))
    cols = sorted(got[0].asDict()) if got else ["key"]
    theirs = con.execute(f"select {', '.join(cols)} from ({evaluation.oracle_sql()[name]})").fetchall() if name != "r1_greedy_pairs" else None
    assert theirs is None or sorted(str(tuple(r[c] for c in cols)) for r in got) == sorted(map(str, theirs))
    assert moved < 8 * Substrate(spark, small).found.count()


def test_violations_by_directions_that_pairs_bring(spark):
    rows = [("k", 1, 2, "contradiction", ["c"], ["t"]), ("k", 1, 2, "agreement", ["c"], ["t"]), ("k", 2, 1, "contradiction", ["t"], ["c"]), ("k", 1, 3, "agreement", ["c"], ["c", "t"]), ("j", 1, 2, "agreement", None, None)]
    pairs = spark.createDataFrame(rows, "key string, paper_a long, paper_b long, label string, da array<string>, db array<string>")
    assert sorted(map(tuple, corpora.pair_violations(pairs).collect())) == [("j", 1, 2), ("k", 1, 2), ("k", 1, 3), ("k", 2, 1)]


def test_greedy_batches_make_their_rows_once(spark):
    """Rows are made once for all strata; of rows without order, with nulls and ties of the draw, the first of each stratum leave their tasks."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = [(None if i % 97 == 0 else i % 90, i, "xyz"[i % 3]) for i in range(3_000)]
    pool = spark.createDataFrame(rows, "a long, b long, label string").repartition(5)
    got = corpora.greedy_batch(pool.mapInArrow(count, pool.schema), "label", {"x": 4, "y": 3}, {("a",): 1}, "s", ["a", "b"], ahead=10).collect()
    assert made.value == 3_000
    assert sorted(map(str, got)) == sorted(map(str, corpora.greedy_batch(pool, "label", {"x": 4, "y": 3}, {("a",): 1}, "s", ["a", "b"], ahead=10_000).collect())) and len(got) == 7
    each = pool.filter("label <> 'z'").withColumns({"_at": F.lit(1), "_draw": F.substring(F.md5(F.col("b").cast("string")), 1, 2)})
    few = corpora._first_of_tasks(each, "label", ["_at", "_draw", "a", "b"], {"x": 50, "y": 9})
    for name, n in (("x", 50), ("y", 9)):
        first = lambda df: [tuple(r) for r in df.filter(F.col("label") == name).orderBy("_at", "_draw", "a", "b").limit(n).collect()]  # noqa: B023, E731
        assert first(few) == first(each) and few.filter(F.col("label") == name).count() <= 5 * n


@pytest.mark.parametrize("look", [8, 1])
def test_hard_negatives_in_cells_are_those_of_all_relations(spark, monkeypatch, look):
    """Papers that mostly share keys, so that many rounds are needed, of which none deals a relation."""
    monkeypatch.setattr(cells, "FIRST_LOOK", look)
    rng = random.Random(6)
    every = list(range(12))
    own = {p: (every, every) if p % 5 else (rng.sample(range(20), rng.randrange(1, 12)), rng.sample(range(20), rng.randrange(1, 12))) for p in range(-2, 38)} | {50: ([0], [1]), 51: ([0], [2]), 52: ([3], [1]), 53: ([99], [99])}
    rule = lambda p, c, d: np.where((p * 7 + c * 5 + d * 3) % 11 % 3 > 0, cells.BOTH, cells.NONE)
    papers = spark.createDataFrame([(p, c, d) for p, (c, d) in own.items()], "paper_id long, lefts array<int>, rights array<int>").repartition(3)
    keys = {p: {(c, d) for c in cs for d in ds if (p * 7 + c * 5 + d * 3) % 11 % 3 > 0} for p, (cs, ds) in own.items()}
    want = set()
    for kind in (0, 1):
        for e in {k[kind] for v in keys.values() for k in v}:
            holders = sorted(p for p, v in keys.items() if any(k[kind] == e for k in v))
            want |= {(kind, e, a, b) for a, b in [(a, b) for a, b in combinations(holders, 2) if not keys[a] & keys[b]][:4]}
    got = cells.hard_negatives(papers, rule).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert cells.hard_negatives(papers.limit(0), rule).count() == 0


def test_shared_keys_by_brute_force():
    rng = random.Random(7)
    own = [(sorted(rng.sample(range(15), rng.randrange(0, 9))), sorted(rng.sample(range(15), rng.randrange(0, 9)))) for _ in range(40)]
    rule = lambda p, c, d: ((p * 5 + c * 3 + d * 7) % 13 < 3).astype(np.uint8)
    keys = [{(c, d) for c in cs for d in ds if (p * 5 + c * 3 + d * 7) % 13 < 3} for p, (cs, ds) in enumerate(own)]
    sides = [(np.cumsum([0, *size[:-1]]), size, np.array([x for o in own for x in o[i]], np.int32)) for i in (0, 1) for size in [np.array([len(o[i]) for o in own])]]
    a, b = np.array(list(combinations(range(40), 2))).T
    for most in (2_000_000, 5):
        assert cells.share_key(rule, np.arange(40), sides, a, b, most).tolist() == [bool(keys[x] & keys[y]) for x, y in zip(a, b, strict=True)]


def test_hard_negatives_deal_no_relation(spark, small):
    got, moved = _rows_moved(spark, lambda: evaluation.queries()["j13_hard_negatives"](spark, small))
    assert got and moved < 10 * Substrate(spark, small).found.count()


def test_mentions_that_nothing_names_are_not_moved(spark):
    """Of words, texts with ties, repeats and hyphens, only those that the dictionary or a linked fragment may name are dealt."""
    rng = random.Random(12)
    vocabulary = ["xy", *(f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in "lmnr")]
    texts = spark.createDataFrame([(p, rng.choice([" ", "-"]).join(rng.choice(vocabulary) for _ in range(400))) for p in range(20)] + [(20, None), (21, "")], "paper_id long, abstract string")
    words = lambda t: ((i, m[0], "C", m.start(), m.end()) for i, m in enumerate(re.finditer("[a-z]+", t)))
    m = spark.createDataFrame([(p, *w) for p, t in ((r.paper_id, r.abstract) for r in texts.collect()) if t for w in words(t)], "paper_id long, ord int, text string, label string, start int, end int")
    whole = [r.abstract for r in texts.collect() if r.abstract and "-" in r.abstract][0]
    names = spark.createDataFrame([("bal", "M1", "Bal", False), ("dem", "M2", "Dem", True), (whole, "M9", "Whole", False), (None, "M8", "none", False)], "alias_key string, concept_id string, name string, tiebroken boolean")
    got, moved = _rows_moved(spark, lambda: linking.canonicalize(m, texts, names, linking.merge_found(texts, words)))
    named = {"bal": ("M1", "Bal", False), "dem": ("M2", "Dem", True)}
    part = {r.paper_id for r in texts.collect() if r.abstract == whole}
    want = sorted(str((*r, *named.get(r.text, ("M9", "Whole", False) if r.paper_id in part else (None, None, False)))) for r in m.collect())
    assert sorted(str(tuple(r)) for r in got) == want and moved < 6_000  # 8,000 words, of which 400 are a fragment's and 200 named
    assert sorted(map(str, linking.canonicalize(m, texts, names).collect())) == sorted(map(str, got))
    rows = m.select("paper_id", "ord")
    assert linking.marked(rows, ["paper_id", "ord"], rows.filter("ord < 9"), "f").filter("f").filter("ord < 9").count() == 20 * 9
    assert linking.marked(rows, ["paper_id", "ord"], rows.filter("ord < 9"), "f").filter("f").count() < 2_000
    assert linking.marked(rows, ["paper_id", "ord"], rows.limit(0), "f").filter("f").count() == 0
