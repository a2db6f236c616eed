"""The training-data operators on small rows: brute force, round trips, held-out accuracy, and awkward rows."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, components, licenses, mixing, passages, pii, quality, secrets, simhash, toxicity, wumanber
from tessera.llm.common import cut, table, word_list

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string"


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, and a column whose name clashes."""
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None, None, None, None, None), (2, "", "en", "a", 0, "x"), (3, words, "en", "a", 1, "x"), (4, words, "en", None, 1, "x"), (4, words, "en", None, 1, "x"), (None, "a b c", "en", "b", 1, "x"), (5, "lang " * 40_000, "en", "b", 1, "x"), (6, "😀 é token=abcdef12 x", "en", "b", 1, "x")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def benchmark(spark, rows=((1, "w1 w2 w3"), (2, None), (None, "zz yy"))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


def auc_of(model, docs, labels):
    held = toxicity.score_documents(docs, model).filter("held_out").join(labels, "doc_id").select("score", "toxic").collect()
    pos, neg = [r.score for r in held if r.toxic], [r.score for r in held if not r.toxic]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_toxicity_accuracy_and_awkward_rows(spark, awkward, empty):
    for sf, least in (("0.01", 0.7), ("0.1", 0.95)):  # a few hundred labelled rows, then some thousand
        docs, labels = table(spark, f"/root/testdata/sf{sf}", "documents"), table(spark, f"/root/testdata/sf{sf}", "labels")
        model = toxicity.fit(toxicity.training_rows(docs, labels))
        auc = auc_of(model, docs, labels)
        print("held-out AUC", sf, auc)
        assert auc > least, auc
    got = toxicity.score_documents(awkward, model).collect()
    assert len(got) == 8 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert toxicity.score_documents(empty, toxicity.fit([])).count() == 0


def test_toxicity_scores_by_brute_force(spark):
    """A plain noisy-or over sentences of a planted vocabulary; all offending sentences are named."""
    rng = random.Random(6)
    bad, good = [f"vile{i}" for i in range(12)], [f"word{i}" for i in range(60)]

    def doc(toxic):
        sents = [" ".join(rng.choice(good) for _ in range(8)) for _ in range(5)]
        spots = rng.sample(range(5), 2) if toxic else []
        for i in spots:
            sents[i] += f" {rng.choice(bad)} {rng.choice(bad)}"
        return ". ".join(sents) + ".", sorted(spots)

    made = [doc(i % 3 == 0) for i in range(600)]
    model = toxicity.fit([(t, int(bool(s))) for t, s in made[:400]])
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(made[400:])], "doc_id long, text string")
    right = 0
    for r in toxicity.score_documents(rows, model).collect():
        text, spots = made[400 + r.doc_id]
        none = 1 - model.leak
        for sent in text.split("."):
            words = {w for w in sent.split()}
            if words:
                z = model.bias + sum(model.weights.get(w, 0) + sum(model.weights.get(w[:n] + b"*", 0) for n in toxicity.STEMS if len(w) > n) for w in (x.encode() for x in words))
                none *= 1 - 1 / (1 + 2.718281828459045**-z)
        assert abs(r.score - (1 - none)) < 1e-6 and r.n_sentences == 5
        right += r.offending == spots
    assert right > 190


def test_training_rows_stay_within_their_bounds(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "TRAIN_ROWS", 50)
    docs = spark.createDataFrame([(i % 40, f"text {i}") for i in range(2000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    rows = toxicity.training_rows(docs, labels)
    assert len(rows) == 50 and rows == toxicity.training_rows(docs.repartition(7), labels)


def test_mixing_by_brute_force(spark, awkward, empty):
    sized = mixing.sizes(awkward)
    got = {r.source: r for r in mixing.targets(sized).collect()}
    size = {}
    for r in sized.collect():
        size[r.source] = size.get(r.source, 0) + r.size
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, open_, rest = {}, set(order), sum(size.values())
    while True:  # clamp, and reshare among the others until none is above
        level = rest / max(sum(weight[s] for s in open_), 1)
        over = {s for s in open_ if level * weight[s] > 3 * size[s]}
        if not over:
            target.update({s: level * weight[s] for s in open_})
            break
        for s in over:
            target[s] = 3.0 * size[s]
            rest -= target[s]
        open_ -= over
    assert all(abs(got[s].target - target[s]) < 1e-6 for s in order)
    cut = mixing.cuts(sized, mixing.targets(sized))
    source_of, taken = {r.doc_id: r.source for r in sized.collect()}, {}
    for r in mixing.draws(sized, cut).collect():
        source = source_of[r.doc_id]
        assert 0 <= r.taken <= 3 * r.size and r.part_from + r.part <= r.size
        taken[source] = taken.get(source, 0) + r.taken
    assert all(abs(taken[s] - target[s]) < 2 for s in order)  # rounding; the repeated rows share a cut evenly
    assert mixing.draws(mixing.sizes(empty), mixing.cuts(mixing.sizes(empty), mixing.targets(mixing.sizes(empty)))).count() == 0
    mixed = mixing.mix_texts(awkward, cut)
    assert mixed.columns == [*awkward.columns, "repetition"]


def test_mix_keeps_texts_of_rows(spark):
    """Clashing columns, repeated and null ids, line breaks, lengths; reruns agree; each source's words are its target."""
    rng = random.Random(3)
    text = lambda n: "".join(f"w{rng.randrange(99)}" + rng.choice([" ", "\n", "\t", "  \n"]) for _ in range(n))
    rows = [(rng.choice([None, 1, 2, 3, i]), t := text(rng.randint(0, 30)), rng.choice(["a", "b", "c", None]), len(t), "p", "w", "f", i) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int, part string, whole string, part_from string, repetition int")
    sized = mixing.sizes(docs)
    cut = mixing.cuts(sized, mixing.targets(sized))
    once, again = (sorted(map(repr, mixing.mix_texts(d, cut).collect())) for d in (docs, docs.repartition(5)))
    assert once == again
    mixed = mixing.mix_texts(docs, cut)
    assert mixed.columns == [*docs.columns, "repetition_"]
    words, cuts = {}, 0
    for r in mixed.collect():
        original = rows[r.repetition]
        assert r.text in original[1] and r.n_chars == len(r.text) and (r.doc_id, r.part, r.whole, r.part_from) == (original[0], "p", "w", "f")
        cuts += r.text != original[1]
        words[r.source] = words.get(r.source, 0) + len(r.text.split())
    assert cuts <= 4
    assert all(abs(words[r.source] - r.target) <= 1 for r in mixing.targets(sized).collect())


def plain_secrets(t):
    out = []
    for m in re.finditer(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        out += [(m.start(), 0, m.end())] * (len(m[2]) >= 6)
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


def test_secrets_by_brute_force(spark, awkward, empty):
    rng = random.Random(5)
    bits = ["token", "TOKEN=", "api_key", "apikey: ", '"', "=", " ", "AKIA", "ABCDEFGH12345678", "deadbeef", "0123456789abcdef", "é😀", "secret", "x", ":", "abc", "\n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(300)]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 7}", 0, "") for i, t in enumerate(texts)], SCHEMA)
    say = lambda spans: ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans)
    for r in secrets.report(secrets.scan_secrets(docs)).collect():
        want = plain_secrets(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(say(want).encode()).hexdigest(), texts[r.doc_id]
        assert set(filter(None, say(want).split(","))) <= set(r.spans.split(","))
    assert secrets.scan_secrets(awkward).count() == 8 and secrets.scan_secrets(empty).count() == 0
    masked = {r.doc_id: r.text for r in secrets.redact(awkward).collect()}
    assert masked[6] == "😀 é [secret] x" and masked[1] is None and secrets.redact(awkward).columns == awkward.columns


def test_wide_copies_are_examples(spark):
    key, own = "Zx9Qw8Er7Ty6Ui5Op4As", "Mn1Bv2Cx3Zl4Kj5Hg6Fd"
    docs = spark.createDataFrame([(i, f"use {key} here", "en", f"s{i}", 0, "") for i in range(6)] + [(9, f"mine {own} ok", "en", "s1", 0, "")], SCHEMA)
    got = {r.doc_id: r for r in secrets.report(secrets.scan_secrets(docs)).collect()}
    assert got[9].spans == "generic:5:25" and all(got[i].spans == "" and got[i].n_example == 1 for i in range(6))


def test_secrets_of_a_text_of_many_keys(spark):
    """Time grows as the number of spans; generic spans that cross base spans go, as all against all says."""
    import time

    rng = random.Random(4)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(32))
    text = " ".join(rng.choice([key(), f"token={key()[:9]}", key().upper() + "x1Y2", "plain"]) for _ in range(16_000))
    start = time.time()
    row = secrets.report(secrets.scan_secrets(spark.createDataFrame([(1, text, "en", "a", 0, "")], SCHEMA))).collect()[0]
    assert row.n_hex > 3_000 and row.n_assign > 3_000 and time.time() - start < 60
    want = plain_secrets(text)
    say = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in want)
    assert row.base_sha256 == hashlib.sha256(say.encode()).hexdigest()
    masked = secrets.redact(spark.createDataFrame([(1, text, "en", "a", 0, "")], SCHEMA)).collect()[0].text
    assert masked.count("[secret]") >= row.n_hex and not re.search(r"\b[0-9a-f]{32}\b", masked)
    spans = [(a, 3, a + rng.randint(16, 30), "v") for a in rng.sample(range(3000), 60)] + [(a, rng.randint(0, 2), a + rng.randint(5, 40), "v") for a in rng.sample(range(3000), 60)]
    kind = "array<struct<start:int,kind:int,end:int,value:string>>"
    generic, base = sorted(s for s in spans if s[1] == 3), sorted(s for s in spans if s[1] < 3)
    df = spark.createDataFrame([(base, generic)], f"base {kind}, generic {kind}")
    got = [tuple(x) for x in df.select(secrets.loose(F.col("base"), F.col("generic")).alias("x")).collect()[0].x]
    assert got == [g for g in generic if not any(b[0] < g[2] and g[0] < b[2] for b in base)]


def test_quality_measures_and_viterbi(spark, awkward, empty):
    rng = random.Random(2)
    for _ in range(200):
        w = [rng.choice("abc").encode() for _ in range(rng.randint(0, 12))]
        wins = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        hit = {i + k for i, x in enumerate(wins) if wins.count(x) > 1 for k in range(3)}
        assert quality.repeated_words(w) == len(hit)
    for _ in range(200):
        t = "".join(rng.choice(["ab", "é😀", "#", "*", "|", " ", "\n", "\t", "x y\n", "\r", "\u00a0"]) for _ in range(rng.randint(0, 30)))
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        n, chars, symbols, _ = quality.measures(t, t.encode())
        assert (n, chars, symbols) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t))
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert quality.line_features(t.encode())[2] == sum(x in lines[:i] for i, x in enumerate(lines))
    crf = quality.Crf((0.5, -2.0, 0.3) + (0.0,) * 15, ((0.4, -0.4), (-0.4, 0.4)))
    for _ in range(100):
        feats = [[0, rng.choice([1, 2])] for _ in range(rng.randint(1, 7))]

        def value(y, feats=feats):
            return sum(sum(crf.emit[f] for f in feats[i]) * y[i] for i in range(len(y))) + sum(crf.move[a][b] for a, b in zip(y, y[1:], strict=False))

        best = max(value([n >> i & 1 for i in range(len(feats))]) for n in range(2 ** len(feats)))
        assert abs(value(crf.viterbi(feats)) - best) < 1e-9
    got = quality.judge(awkward, crf).collect()
    assert len(got) == 8 and not any(r.kept for r in got if r.n_words < 50) and quality.judge(empty, quality.fit([])).count() == 0


def test_quality_finds_planted_boilerplate(spark):
    """Menus in good documents and paragraphs in bad ones get a line's own label, though only documents are labelled."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 9)))
    prose = lambda: " ".join(word() for _ in range(rng.randint(18, 40))).capitalize() + "."
    menu = lambda: " | ".join(word().capitalize() for _ in range(rng.randint(3, 6)))

    def doc(good):
        lines = [(prose(), 1) if (rng.random() < 0.85) == good else (menu(), 0) for _ in range(rng.randint(8, 20))]
        return "\n".join(x for x, _ in lines), [y for _, y in lines]

    made = [(doc(i % 2 == 0), int(i % 2 == 0)) for i in range(400)]
    model = quality.fit([(t, y) for (t, _), y in made[:300]])
    right = total = 0
    for (t, labels), _ in made[300:]:
        got = model.viterbi(quality.line_features(t.encode())[0])
        right, total = right + sum(a == b for a, b in zip(got, labels, strict=True)), total + len(labels)
    assert right / total > 0.97
    rows = spark.createDataFrame([(i, t) for i, ((t, _), _) in enumerate(made[300:])], "doc_id long, text string")
    for r in quality.judge(rows, model).collect():
        (t, labels), _ = made[300 + r.doc_id]
        sizes = [len(line.split()) for line in t.split("\n")]
        share = sum(n for n, y in zip(sizes, labels, strict=True) if y) / sum(sizes)
        assert abs(r.content_share - share) < 0.2 and (abs(share - 0.5) < 0.2 or r.kept == (share > 0.5 and not r.base_failed))
    golds = quality.gold_labels([(quality.line_features(t.encode())[0], y) for (t, _), y in made[:300]])
    assert sum(len(set(g)) == 2 for g in golds) > 200


def test_pii_base_by_brute_force(spark, awkward, empty):
    model = pii.fit()
    kinds = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    rng = random.Random(3)

    def good(k, s):
        d = re.findall("[0-9]", s)
        return (True, k != 1 or all(int(p) <= 255 for p in s.split(".")), 16 <= len(d) <= 19 and pii.luhn("".join(d)), 8 <= len(d) <= 15)[k]

    for _ in range(5000):
        t = "".join(rng.choice("a1.@+- (b2;.1@") for _ in range(rng.randint(0, 40)))
        assert sorted(pii.base_spans(t)) == sorted((k, m.start(), m.end()) for k, p in enumerate(kinds) for m in re.finditer(p, t) if good(k, m[0]))
    x, y = pii.examples(400, 99)
    right = sum((model.chance(list(r)) >= model.thresholds[int(r[0])]) == bool(v) for r, v in zip(x, y, strict=True))
    assert right / 400 > 0.9
    assert pii.find_pii(awkward, model).count() == 8 and pii.find_pii(empty, model).count() == 0
    assert pii.redact("mail a@b.co now", model) == "mail [email] now" and pii.redact(None, model) is None


# Written by hand, apart from the rules that make the training examples: what must be found in a sentence, and sentences without.
PRIVATE = (
    ("Please call me back on 0301234567 before noon.", "0301234567"), ("Her account 12345678901 was closed in May.", "12345678901"), ("You can reach us: (415) 555-0182, any day.", "(415) 555-0182"), ("SSN 078-05-1120 was printed on the form", "078-05-1120"), ("Meine IBAN lautet DE89 3704 0044 0532 0130 00, danke.", "DE89 3704 0044 0532 0130 00"),
    ("wire it to GB82WEST12345698765432 by Friday", "GB82WEST12345698765432"), ("Fax: 555-867-5309", "555-867-5309"), ("dm me, I am @maria_92 there", "@maria_92"), ("his mobile 0171 234 567 is off", "0171 234 567"), ("tel 0301234567", "0301234567"),
)
PUBLIC = (
    "The meeting of 2024-05-13 was moved to 14/06/2024.", "It sold 1234567 copies in the 1990-2000 decade.", "version 10.4.22.105.7 fixes the bug", "order 55512345 left the warehouse", "the price was 19999.95 in total", "see pages 112-118 and 220-231", "@override public void run()", "chapter 12 34 56 7", "part number XK12 4455 6677 ABCD is out of stock", "ISBN 9783161484100 is out of print",
)


def test_pii_on_sentences_written_by_hand():
    model = pii.fit()
    found = [any(t[a:b] == want for _, a, b, _ in pii.find_spans(t, model)[1]) for t, want in PRIVATE]
    clean = [not pii.find_spans(t, model)[1] for t in PUBLIC]
    print("found", found, "clean", clean)
    assert sum(found) >= 9 and sum(clean) >= 9


def test_pii_of_a_text_of_many_spans():
    import time

    model, rng = pii.fit(), random.Random(1)
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    t = " ".join(rng.choice([f"a{d(3)}@b.co", f"call 0{d(3)} {d(3)} {d(3)}", f"({d(3)}) {d(3)}-{d(4)}"]) for _ in range(8_000))
    start = time.time()
    base, added = pii.find_spans(t, model)
    assert len(base) + len(added) > 6_000 and time.time() - start < 20
    assert all(x[2] <= y[1] for x, y in zip(sorted(added, key=lambda s: s[1]), sorted(added, key=lambda s: s[1])[1:], strict=False))


def test_passages_find_planted_ones(spark, awkward, empty):
    rng = random.Random(7)
    w = lambda n: [f"{rng.choice('abcdef')}{rng.randrange(10**6)}" for _ in range(n)]
    shared = w(60)
    fuzzy = [x if i % 17 else "changed" for i, x in enumerate(shared)]
    docs = [w(80) + shared + w(30), w(10) + shared + w(90), w(120), w(40) + fuzzy + w(20)]
    rows = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)] + [(7, " ".join(docs[2]))], "doc_id long, text string")
    got = {(r.doc_id, r.ref_id): r for r in passages.find_passages(rows).collect()}
    assert set(got) == {(1, 0), (3, 0), (7, 2)}
    assert (got[1, 0].start, got[1, 0].end, got[1, 0].ref_start, got[1, 0].ref_end) == (10, 70, 80, 140) and got[7, 2].n_anchors is None
    assert {(r.doc_id, r.ref_id) for r in passages.find_passages(awkward).collect()} == {(4, 3)} and passages.find_passages(empty).count() == 0


def test_chains_equal_a_quadratic_search_within_the_widest_gap():
    rng, reach = random.Random(2), passages.WIDEST_GAP + passages.K
    for n in range(300):
        a = sorted({(rng.randrange(300), rng.randrange(300)) for _ in range(rng.randint(1, 60))} | {(5 * i, 5 * i + rng.randrange(3)) for i in range(n % 40)})
        best = {}
        for p, r in a:
            gain = max((best[q, s] - 0.1 * (p - q + r - s) for q, s in best if 0 < p - q <= reach and 0 < r - s <= reach), default=0.0)
            best[p, r] = passages.K + max(gain, 0.0)
        got = passages.chains(a)
        assert sorted(x for c in got for x in c) == a
        assert all(0 < y[0] - x[0] <= reach and 0 < y[1] - x[1] <= reach for c in got for x, y in zip(c, c[1:], strict=False))
        top = got[0]
        assert abs(passages.K * len(top) - 0.1 * (top[-1][0] - top[0][0] + top[-1][1] - top[0][1]) - max(best.values())) < 1e-9
    for first, gap in ((200, 60), (200, 400), (400, 60), (400, 80)):
        runs = [[(i, i) for i in range(0, first, 6)], [(i, i) for i in range(first + gap, first + gap + 100, 6)]]
        assert passages.chains(runs[0] + runs[1]) == runs


def test_every_place_of_a_passage_is_located(spark):
    rng = random.Random(8)
    w = lambda n: [f"{rng.choice('abcdef')}{rng.randrange(10**6)}" for _ in range(n)]
    one, two, three = w(60), w(60), w(60)
    docs = [w(30) + one + w(20) + three[:20] + w(70), w(10) + one + w(70) + one + w(90) + one, w(5) + two + w(80) + two + w(9), w(40) + two + w(20), w(7) + three + w(9), w(8) + three[:25] + w(60) + three + w(3)]
    rows = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    got = passages.find_passages(rows).collect()
    places = {(r.doc_id, r.start, r.end) for r in got} | {(r.ref_id, r.ref_start, r.ref_end) for r in got}
    assert {(0, 30, 90), (1, 10, 70), (1, 140, 200), (1, 290, 350), (2, 5, 65), (2, 145, 205), (3, 40, 100), (4, 7, 67), (5, 93, 153)} == places


def test_passages_whose_parts_occur_in_earlier_documents(spark):
    rng = random.Random(9)
    w = lambda n: [f"{rng.choice('abcdef')}{rng.randrange(10**6)}" for _ in range(n)]
    shared = [w(50 + i) for i in range(12)]
    parts = [w(30) + s[at : at + 12] + w(40) for s in shared for at in range(0, len(s) - 5, 3)]
    rng.shuffle(parts)
    both = [[w(10 + 3 * i) + s + w(20) for i, s in enumerate(shared)] for _ in range(3)]
    docs = parts + both[0] + both[1] + both[2]
    rows = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    got = passages.find_passages(rows).collect()
    n = len(parts)
    places = {(r.doc_id, r.start, r.end) for r in got} | {(r.ref_id, r.ref_start, r.ref_end) for r in got}
    assert places == {(n + 12 * k + i, 10 + 3 * i, 60 + 4 * i) for k in (0, 1, 2) for i in range(12)}
    assert len({frozenset((r.doc_id, r.ref_id)) for r in got}) == 24  # a first holder and the last may name each other
    assert all((r.doc_id - r.ref_id) % 12 == 0 for r in got)


def test_passages_by_cases(spark):
    """Two passages far apart, passages whose halves stand elsewhere, rows of one id and other texts, rows without an id."""
    rng = random.Random(13)
    w = lambda n: [f"{rng.choice('abcdef')}{rng.randrange(10**6)}" for _ in range(n)]
    p, q, both, long, short = w(70), w(70), w(70), w(300), w(60)
    texts = [(0, p + q), (1, p + w(60) + q), (2, both[:40] + w(30) + both[30:]), (3, w(9) + both + w(5)), (4, w(3) + both + w(20)), (5, long), (5, short), (6, long), (None, w(4) + short + w(2)), (None, long)]
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in texts], "doc_id long, text string")
    got = passages.find_passages(rows).collect()
    places = {(r.doc_id, r.start, r.end) for r in got} | {(r.ref_id, r.ref_start, r.ref_end) for r in got}
    assert {(0, 0, 70), (0, 70, 140), (1, 0, 70), (1, 130, 200)} <= places or {(0, 0, 140), (1, 0, 70), (1, 130, 200)} <= places
    assert {(3, 9, 79), (4, 3, 73), (5, 0, 300), (6, 0, 300), (5, 0, 60), (None, 4, 64), (None, 0, 300)} <= places


def test_passages_recall_by_identity(spark):
    """100 planted pairs of 100-word passages for each number of replaced words, by brute force all above the least identity."""
    rng = random.Random(14)
    w = lambda n: [f"{rng.choice('abcdef')}{rng.randrange(10**6)}" for _ in range(n)]
    rows, pairs = [], {}
    for changed in (10, 15, 18):
        for _ in range(100):
            a = w(100)
            b = list(a)
            for i in rng.sample(range(100), changed):
                b[i] = w(1)[0]
            i = len(rows)
            rows += [(i, " ".join(w(40) + a + w(40))), (i + 1, " ".join(w(25) + b + w(60)))]
            pairs[i, i + 1] = changed
    got = {(min(r.doc_id, r.ref_id), max(r.doc_id, r.ref_id)) for r in passages.find_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = {c: sum(p in got for p, x in pairs.items() if x == c) for c in (10, 15, 18)}
    print("found of 100", found)
    assert min(found.values()) >= 90 and got <= set(pairs)


def test_runs_equal_brute_force():
    rng = random.Random(10)
    for _ in range(40):
        common = [[rng.randrange(10**6) for _ in range(rng.randint(45, 90))] for _ in range(3)]
        docs = [[x for _ in range(4) for x in rng.choice(common)[rng.randrange(20) :] + [rng.randrange(10**6) for _ in range(rng.randrange(30))]] for _ in range(2)]
        h = [passages.word_hashes(" ".join(map(str, d))) for d in docs]
        found = [(v[~soft], at[~soft]) for v, at, soft in map(passages.seeds, h)]
        held = [set(v.tolist()) for v, _ in found]
        got = []
        for x, (v, at) in zip(h, found, strict=True):
            both = passages.np.array([s in held[0] & held[1] for s in v.tolist()], bool)
            where = passages.stretches(at[both], passages.reaches(at, len(x))[both], 50) if both.any() else []
            got.append(passages.runs(x, where, 50))
        grams = [{} for _ in docs]
        for d, g in zip(docs, grams, strict=True):
            for i in range(len(d) - 49):
                g.setdefault(tuple(d[i : i + 50]), set()).add(i)
        for me, other, (v, at) in zip(grams, grams[::-1], got, strict=True):
            assert {i for k, places in me.items() if k in other for i in places} <= set(at.tolist())
        assert set(got[0][0].tolist()) & set(got[1][0].tolist()) or not set(grams[0]) & set(grams[1])
    at = passages.np.array([9, 0, 1])
    assert passages.run_anchors(at, at + 5, 50) == [(p, p + 5) for p in range(0, 9 + 50 - passages.K + 1, passages.K)]


def test_chat_round_trip(spark):
    rows = [(1, 0, "system", "be <s> [INST] \\ | brief"), (1, 1, "user", None), (1, 2, "assistant", "</s>\n<|user|>\nno \\< \\\\[ end\\"), (2, 0, "assistant", "first"), (None, 0, "user", "x"), (3, None, None, ""), (3, 1, "us|>er", "y"), (3, 1, "us|>er", "y")]
    back = {r.conv_id: r for r in chat.read_back(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert [(t.role, t.text) for t in back[1].turns] == [("system", rows[0][3]), ("user", ""), ("assistant", rows[2][3])]
    assert back[1].loss_text == rows[2][3] and back[1].valid and not back[2].valid and not back[3].valid
    assert [(t.role, t.text) for t in back[3].turns] == [("", ""), ("us|>er", "y"), ("us|>er", "y")] and set(back) == {1, 2, None, 3}
    assert back[1].formatted.count("</s>") == 3
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_chats(none)).count() == 0
    long = "x</s>\\[ " * 100_000
    wide = spark.createDataFrame([(1, 0, "user", "a", "t", True), (1, 1, "assistant", long, "t", False)], "conv_id long, turn long, role string, text string, turns string, loss boolean")
    (one,) = chat.read_back(chat.format_chats(wide)).collect()
    assert one.loss_text == long and one.valid and one.turns[1].text == long


def test_wu_manber_by_brute_force(spark, awkward, empty):
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    items = [(i, text(rng.randint(0, 18))) for i in range(25)]
    searches = wumanber.build(items)
    for _ in range(200):
        words = word_list(text(rng.randint(0, 40)))
        hit, names = set(), set()
        for i, t in items:
            w = word_list(t)
            m = min(13, len(w))
            for k in range(len(w) - m + 1 if m else 0):
                for j in range(len(words) - m + 1):
                    if words[j : j + m] == w[k : k + m]:
                        hit |= set(range(j, j + m))
                        names.add(str(i))
        ranges, found = wumanber.hits(words, searches)
        assert sum(b - a for a, b in ranges) == len(hit) and found == names
    got = {r.doc_id: r for r in wumanber.find_contamination(awkward, benchmark(spark)).collect()}
    assert (got[3].n_hit, got[3].n_items, got[3].contaminated) == (3, 1, True) and got[1].n_words == 0
    assert wumanber.find_contamination(empty, benchmark(spark)).count() == 0 and wumanber.find_contamination(awkward, benchmark(spark, ())).filter("n_hit > 0").count() == 0
    docs = spark.createDataFrame([(i, " ".join(rng.choice("abc") for _ in range(40)), f"x{i}") for i in range(30)] + [(30, None, "y")], "doc_id long, text string, hits string")
    tests = spark.createDataFrame(items, "item_id long, text string")
    assert len(wumanber._blocks(tests, "item_id", "text", 10)) > 2
    one, many = (sorted(map(tuple, wumanber.find_contamination(docs, tests, held_words=n).collect()), key=repr) for n in (10**6, 10))
    assert one == many and any(r[2] for r in one)
    kept = [sorted(map(tuple, wumanber.drop_contaminated(docs, tests, held_words=n).collect()), key=repr) for n in (10**6, 10)]
    assert kept[0] == kept[1] and {r[0] for r in kept[0]} == {r[0] for r in one if not r[5]}


def test_licences(spark, awkward, empty):
    n, k, a, b, base, labels, score = licenses.scan("Used under the MIT License. Also: Apache License, Version 2.0; under the mit license")
    assert (n, k, a, b, base) == (15, 3, 1, 11, {"mit", "apache-2"}) and labels == base and score == 0.9
    assert licenses.scan("under the terms of the GNU General Public License, version 3 licensed under gnu gplv3")[5] == {"gpl-3"}
    assert len(licenses.rules()) > 200
    assert licenses.scan_licenses(awkward).count() == 8 and licenses.scan_licenses(empty).count() == 0


# Written by hand: texts and the labels that they bear.
LICENSED = (
    ("read the BSD for details", {"bsd"}), ("see the MPL 2.0 for details", {"mpl-2"}), ("https://opensource.org/licenses/MIT", {"mit"}), ("SPDX-License-Identifier: ISC", {"isc"}), ("http://creativecommons.org/licenses/by-sa/4.0/", {"cc-by-sa"}), ("Licensed under the Eclipse Public License 2.0", {"epl-2"}), ("This is free and unencumbered software released into the public domain.", {"unlicense"}),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted", {"bsd"}), ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", {"mit"}), ("You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", {"apache-2"}),
    ("under the same terms as Perl itself", {"perl"}), ("GNU Free Documentation License", {"gfdl"}), ("under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", {"gpl-3"}), ("Llama 3.1 Community License Agreement", {"llama"}), ("all rights reserved", {"proprietary"}),
    ("I commit to submit a permit under review", set()), ("the mit campus is large", set()), ("a license to drive", set()), ("details of the bsd family", set()), ("", set()),
)


def test_licences_of_labelled_texts():
    got = {t: {s[3] for s in licenses.detect(b" " + b" ".join(word_list(t)) + b" ")} for t, _ in LICENSED}
    assert all(got[t] == want for t, want in LICENSED), {t: got[t] for t, want in LICENSED if got[t] != want}


def test_every_rule_passes_its_own_gate():
    """A text that is a rule's own words meets the rule's keywords and cues: the prefilter never hides a match."""
    for _, _, keys, cues, pattern in licenses.rules():
        words = pattern.pattern.removeprefix("(?<![^ ])").removesuffix("(?![^ ])")
        # the shortest word of each optional or alternative part
        while (m := re.search(r"\(\?:([^()]*)\)(\?)?", words)) is not None:
            words = words[: m.start()] + ("" if m[2] else m[1].split("|")[0]) + words[m.end() :]
        words = re.sub(r"\[(.)[^\]]*\]", r"\1", re.sub(r"[a-z ]\?", "", words))
        line = f" {words.strip()} ".encode()
        if pattern.search(line.decode()):
            assert any(k in line for k in keys) and any(c in line for c in cues), words


def test_suppression_by_brute_force():
    rng = random.Random(5)
    for _ in range(100):
        found = list({(a, p): (a, a + rng.randint(1, 20), p, "x") for a, p in ((rng.randrange(40), rng.choice([40, 60, 80])) for _ in range(rng.randint(0, 25)))}.values())
        stay = []
        for s in sorted(found, key=lambda s: (-s[2], s[0] - s[1], s[0])):
            if not any(a <= s[0] and s[1] <= b for a, b, _, _ in stay):
                stay.append(s)
        assert licenses.suppress(found) == sorted(stay)


def test_simhash_by_brute_force(spark, awkward, empty, small):
    got = simhash.near_duplicates(table(spark, small, "documents")).collect()
    f = {r.doc_id: int(r.fingerprint, 16) for r in got}
    least = {}
    for i in sorted(f):
        if i not in least:
            least[i], todo = i, [i]
            while todo:
                x = todo.pop()
                for y in f:
                    if y not in least and (f[x] ^ f[y]).bit_count() <= 2:
                        least[y] = i
                        todo.append(y)
    assert all(r.component_id == least[r.doc_id] for r in got)
    a = simhash.near_duplicates(awkward).collect()
    assert len(a) == 8 and {r.component_id for r in a if r.doc_id in (1, 2)} == {1} and simhash.near_duplicates(empty).count() == 0


def test_pairs_meet_through_pivot_coordinates(spark, monkeypatch):
    """All pairs within the radius are found, few others meet, and without the references' coordinates every pair does."""
    rng = random.Random(21)
    roots = [rng.getrandbits(64) for _ in range(120)]
    prints = sorted({r ^ sum(1 << b for b in rng.sample(range(64), k)) for r in roots for k in (0, 1, 2, 3, 4)})
    df = spark.createDataFrame([(simhash._signed(x),) for x in prints], "f long")
    want = {(simhash._signed(x), simhash._signed(y)) for x in prints for y in prints if x != y and (x ^ y).bit_count() <= 2}
    assert {p for r in simhash.links(df).collect() for p in ((r.fa, r.fb), (r.fb, r.fa))} == want

    def met():
        rows = simhash.meetings(simhash.pivot_table(df), 2)
        return rows.alias("a").join(rows.alias("b"), "key").filter("a.f < b.f").select("a.f", "b.f").distinct().count()

    assert met() < 4 * len(want)
    monkeypatch.setattr(simhash, "pair_references", lambda: [0] * 32)
    assert met() == len(prints) * (len(prints) - 1) // 2


def test_keys_of_fingerprints_are_not_broadcast(spark):
    """A table of fingerprints below the limit of a broadcast has 28 keys a row, which Spark's sizes leave out."""
    prints = cut(spark.range(20_000).select(F.xxhash64("id").alias("f")))
    assert "Broadcast" not in simhash.links(prints)._jdf.queryExecution().executedPlan().toString()


def test_near_copies_keep_one_of_each(spark, awkward, empty):
    rng = random.Random(9)
    w = [f"{rng.choice('abcdef')}{rng.randrange(10**6)}" for _ in range(300)]
    rows = [(0, " ".join(w)), (1, " ".join(w)), (2, " ".join([*w[:150], "new", *w[151:]])), (3, " ".join(rng.choice(w) for _ in range(300))), (None, " ".join(w)), (None, "alone " * 9), (3, "other text of one id")]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted((rows[i] for i in (0, 3, 5, 6)), key=repr)
    assert simhash.one_of_each(awkward).columns == awkward.columns and simhash.one_of_each(empty).count() == 0


def similar_groups(texts):
    """Least number of each text's group by all pairs."""
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := t.lower().split()) else set() for t in texts]
    least = list(range(len(texts)))

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if (not x and not y) or (x and y and 9 * len(x & y) >= 4 * (len(x) + len(y))):
                a, b = sorted((root(i), root(j)))
                least[b] = a
    return [root(i) for i in range(len(texts))]


def test_near_copies_by_all_pairs(spark, small):
    """At 0.75 texts stay apart, at 0.8 and 0.85 they meet; then a family around 0.8 and the given documents, by all pairs."""
    rng = random.Random(11)
    w = lambda n: [f"{rng.choice('abcdef')}{rng.randrange(10**6)}" for _ in range(n)]

    def pair(shared, own):  # two texts of shared + own shingles each
        a, b = w(shared + 4), w(own)
        return [" ".join(a + b), " ".join(a + w(own))]

    texts, near = [], {}
    for j, (shared, own) in {0.75: (300, 50), 0.80: (320, 40), 0.85: (340, 30)}.items():
        for _ in range(60):
            near[len(texts)] = j
            texts += pair(shared, own)
    root = w(150)
    texts += [" ".join([*root[:i], *w(2), *root[i + 2 :][: 148 - 3 * k]]) for k in range(4) for i in range(10, 100, 6)]
    docs = [r.text or "" for r in table(spark, small, "documents").orderBy("doc_id").collect()]
    for some in (texts, docs):
        got = {r.doc_id: r.first_id for r in simhash.near_copies(spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")).collect()}
        want = similar_groups(some)
        assert [i for i in range(len(some)) if got[i] != want[i]] == []
    met = {j: sum(want_i != i for i, want_i in enumerate(similar_groups(texts)) if near.get(i - 1) == j) for j in (0.75, 0.80, 0.85)}
    assert met == {0.75: 0, 0.80: 60, 0.85: 60}


def test_near_copies_meet_by_pivot_coordinates(spark, monkeypatch):
    """Without any band, all copies meet whose fingerprints differ by two bits or fewer."""
    rng = random.Random(17)
    w = lambda n: [f"{rng.choice('abcdef')}{rng.randrange(10**6)}" for _ in range(n)]
    texts = [t for _ in range(60) for a in [w(400)] for t in (" ".join(a), " ".join(a + w(1)))]
    first = [simhash.fingerprint(t, simhash.COPY_WORDS)[0] for t in texts]
    near = {i + 1 for i in range(0, len(texts), 2) if 0 < (first[i] ^ first[i + 1]).bit_count() <= simhash.COPY_RADIUS}
    monkeypatch.setattr(simhash, "bands", lambda distinct: [])
    got = {r.doc_id for r in simhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect() if r.first_id == r.doc_id - 1}
    assert len(near) >= 10 and near <= got


def test_components_of_long_chains(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components.components(links).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100


def test_pipeline_runs_over_awkward_rows(spark, awkward, empty, tmp_path):
    import corpus_pipeline

    for name, docs in (("a", awkward), ("e", empty)):
        d = str(tmp_path / name)
        spark.createDataFrame([(3, 1, 0), (6, 0, 1), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        benchmark(spark, ((1, "nothing here"),)).write.parquet(f"{d}/benchmark.parquet")
        docs.write.parquet(f"{d}/documents.parquet")
        out = corpus_pipeline.run(spark, d)
        assert set(docs.columns) <= set(out.columns) and (name == "a") == (out.count() > 0)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, d).columns == docs.columns
