"""Text, licence, linking, pairing, question and scoring operators on small rows, and queries against SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera.functions import licence, stats, text
from tessera.operators import linking, pairing, question, scoring
from tessera.plans import registry


def test_sentences_cover_edges(spark):
    rows = spark.createDataFrame([(1, "One. Two!  Three? "), (2, ""), (3, "a😀b. c"), (4, " lead. x")], "paper_id long, abstract string")
    got = {(r.paper_id, r.sentence_index): (r.start, r.end, r.text) for r in text.sentences(rows).collect()}
    assert got == {(1, 0): (0, 4, "One."), (1, 1): (5, 9, "Two!"), (1, 2): (11, 17, "Three?"), (2, 0): (0, 0, ""), (3, 0): (0, 4, "a😀b."), (3, 1): (5, 6, "c"), (4, 0): (0, 6, " lead."), (4, 1): (7, 8, "x")}


def test_rows_of_one_key_keep_their_own_offsets(spark):
    texts = ["Alpha beta. Gamma", "Alpha beta. Gamma", "x Alpha! Delta y", None, ""]
    rows = spark.createDataFrame([(1, t) for t in texts], "paper_id long, abstract string")
    words = sorted((r.pos, r.match, r.start, r.end) for r in text.pieces(rows, "paper_id", "abstract", r"[A-Za-z]{4,}").collect())
    assert words == sorted([(0, "Alpha", 0, 5), (1, "beta", 6, 10), (2, "Gamma", 12, 17)] * 2 + [(0, "Alpha", 2, 7), (1, "Delta", 9, 14)])
    sents = sorted((r.sentence_index, r.start, r.end) for r in text.sentences(rows).collect())
    assert sents == sorted([(0, 0, 11), (1, 12, 17)] * 2 + [(0, 0, 8), (1, 9, 16), (0, 0, 0)])
    both = sorted((r.sentence_index, r.match, r.start, r.end) for r in text.sentence_pieces(rows, "paper_id", "abstract", r"[A-Za-z]{4,}").collect())
    assert both == sorted([(0, "Alpha", 0, 5), (0, "beta", 6, 10), (1, "Gamma", 12, 17)] * 2 + [(0, "Alpha", 2, 7), (1, "Delta", 9, 14)])


def test_walks_over_long_arrays(spark):
    from tessera.functions.arrays import walk

    xs = [(i * 7) % 11 for i in range(1500)]
    got = spark.createDataFrame([(xs,), ([],)], "xs array<int>").select(walk(F.col("xs"), F.lit(0), lambda at, x: at + x, lambda at, x: at + x).alias("s")).collect()
    assert got[0].s == [sum(xs[: i + 1]) for i in range(1500)] and got[1].s == []


def test_normalized_surfaces(spark):
    rows = spark.createDataFrame([("  STRAßE  ",), ("a\u00a0\t b",), ("ΟΔΟΣ",), (None,)], "s string")
    assert [r.n for r in rows.select(text.normalize_surface(F.col("s")).alias("n")).collect()] == ["strasse", "a b", "οδοσ", None]


def test_merged_fragments_fill_unlinked_mentions_only(spark):
    t = spark.createDataFrame([(1, "GLP-1RA and N-methyl acid")], "paper_id long, abstract string")
    m = spark.createDataFrame([(1, 0, "GLP", "CHEMICAL", 0, 3), (1, 1, "1RA", "CHEMICAL", 4, 7), (1, 2, "N", "CHEMICAL", 12, 13), (1, 3, "methyl", "CHEMICAL", 14, 20), (1, 4, "acid", "CHEMICAL", 21, 25)], "paper_id long, ord int, text string, label string, start int, end int")
    names = spark.createDataFrame([("glp-1ra", "M1", "GLP-1RA", True, 0), ("methyl", "M2", "Methyl", True, 0), ("n-methyl", "M3", "N-Methyl", True, 0)], "alias_key string, concept_id string, name string, is_preferred boolean, ord int")
    got = {r.ord: (r.canonical_id, r.canonical_name) for r in linking.canonicalize(m, t, linking.resolve_aliases(names)).collect()}
    assert got == {0: ("M1", "GLP-1RA"), 1: ("M1", "GLP-1RA"), 2: ("M3", "N-Methyl"), 3: ("M2", "Methyl"), 4: (None, None)}


def test_pairs_of_a_large_key_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(pairing, "PAIR_BLOCK", 7)
    rows = [("a", p) for p in range(40)] + [("b", p) for p in (3, 50, 51)]
    long = spark.createDataFrame([(k, p, sum(x == k for x, _ in rows)) for k, p in rows], "key string, paper_id long, n_papers long")
    want = {(p, q) for k in "ab" for x, p in rows for y, q in rows if x == y == k and p < q}
    assert sorted(map(tuple, pairing.paper_pairs(long).collect())) == sorted(want)


@pytest.mark.parametrize("raw,token,tier", [("CC BY", "cc_by", "open"), ("cc-by--nc", "cc_by_nc", "non_commercial"), ("https://creativecommons.org/licenses/by-nc-nd/4.0/", "cc_by_nc_nd", "non_commercial"), ("https://evil.org/creativecommons.org/licenses/by/4.0", "https://evil.org/creativecommons.org/licenses/by/4.0", "unknown"), ("no-cc-code", "no_cc_code", "restricted")])
def test_licences(spark, raw, token, tier):
    r = spark.createDataFrame([(raw,)], "x string").select(licence.any_token(F.col("x")).alias("t"), licence.tier(licence.any_token(F.col("x"))).alias("tier")).first()
    assert (r.t, r.tier) == (token, tier)


def test_alias_ties_prefer_preferred_then_least_id(spark):
    rows = spark.createDataFrame([("a", "M2", "x", True, 0), ("a", "M1", "y", False, 1), ("b", "M9", "p", True, 0), ("b", "M3", "q", True, 1), ("c", "M5", "z", False, 0), (" ", "M6", "w", True, 0)], "alias_key string, concept_id string, name string, is_preferred boolean, ord int")
    assert {(r.alias_key, r.concept_id, r.tiebroken) for r in linking.resolve_aliases(rows).collect()} == {("a", "M2", True), ("b", "M3", True), ("c", "M5", False)}


def test_pairs_need_one_sentence_and_links(spark):
    m = spark.createDataFrame([(1, 0, "CHEMICAL", "C", 0), (1, 6, "DISEASE", "D", 0), (1, 4, "DISEASE", "E", 0), (1, 7, "DISEASE", None, 0)], "paper_id long, start int, label string, canonical_id string, ord int")
    s = spark.createDataFrame([(1, 0, 0, 4), (1, 1, 5, 9)], "paper_id long, sentence_index int, start int, end int")
    assert pairing.same_sentence_pairs(linking.in_sentences(m, s)).count() == 0
    assert {(r.chemical_id, r.disease_id) for r in pairing.cross_pairs(m).collect()} == {("C", "D"), ("C", "E")}


def test_fragments_merge_across_hyphens_only(spark):
    t = spark.createDataFrame([(1, "N-methyl acid and plain-words here")], "paper_id long, abstract string")
    m = spark.createDataFrame([(1, 0, "N", "CHEMICAL", 0, 1), (1, 1, "methyl", "CHEMICAL", 2, 8), (1, 2, "acid", "CHEMICAL", 9, 13), (1, 3, "plain", "CHEMICAL", 18, 23), (1, 4, "words", "CHEMICAL", 24, 29)], "paper_id long, ord int, text string, label string, start int, end int")
    assert [(r.start, r.end, r.text, r.n_parts) for r in linking.merge_fragments(m, t).collect()] == [(0, 8, "N-methyl", 2)]


def test_contained_spans_go_and_equal_ones_stay(spark):
    rows = spark.createDataFrame([(1, 0, 9), (1, 2, 5), (1, 0, 9), (1, 5, 12), (1, None, 3)], "g int, start int, end int")
    assert sorted(((r.start, r.end) for r in linking.drop_contained(rows, ["g"]).collect()), key=str) == [(0, 9), (0, 9), (5, 12), (None, 3)]


def test_distance_by_nodes(spark):
    tree = spark.createDataFrame([("A", "1.2.3"), ("B", "1.2.4"), ("C", "12.2"), ("D", "1")], "concept_id string, tree_number string")
    pairs = spark.createDataFrame([("A", "B"), ("A", "C"), ("A", "D"), ("A", "Z")], "a string, b string")
    assert {(r.b): r.distance for r in question.distances(pairs, tree).collect()} == {"B": 2, "C": None, "D": 2, "Z": None}


def test_census_without_predictions_is_missed(spark):
    gold = spark.createDataFrame([(1, "A", 0, 5), (2, "A", 0, 5), (3, "A", 0, 9), (4, "A", 0, 5)], "paper_id long, label string, start int, end int")
    pred = spark.createDataFrame([(2, "A", 0, 5), (3, "A", 0, 3), (3, "A", 4, 9), (4, "A", 3, 8)], "paper_id long, label string, start int, end int")
    assert {r.paper_id: r.outcome for r in scoring.census(gold, pred).collect()} == {1: "MISSED", 2: "EXACT", 3: "MERGEABLE", 4: "TRUNCATED"}


def test_multiset_and_set_scores_differ(spark):
    g, p = spark.createDataFrame([(1,), (1,), (2,)], "k int"), spark.createDataFrame([(1,), (3,)], "k int")
    m, s = scoring.multiset_scores(g, p, ["k"]).first(), scoring.set_scores(g, p, ["k"]).first()
    assert (m.tp, m.fp, m.fn) == (1, 1, 2) and (s.tp, s.fp, s.fn) == (1, 1, 1)


def test_statistics(spark):
    low, high = stats.wilson(F.col("k"), F.col("n"))
    rows = spark.createDataFrame([(0, 0), (0, 5), (5, 5), (1, 15)], "k int, n int").select("k", "n", low.alias("l"), high.alias("h")).collect()
    assert (rows[0].l, rows[0].h) == (0.0, 1.0) and rows[1].l == 0.0 and rows[2].h == 1.0 and round(rows[3].l, 3) == 0.012 and round(rows[3].h, 3) == 0.298
    p = [r.p for r in spark.createDataFrame([(0, 0), (1, 9), (5, 5)], "b int, c int").select(stats.mcnemar(F.col("b"), F.col("c")).alias("p")).collect()]
    assert p[0] == 1.0 and abs(p[1] - 22 / 1024) < 1e-9 and p[2] == 1.0


@pytest.mark.parametrize("name", ["a1_cluster_papers", "a2_resolve_aliases", "f2_sentences", "j12_drop_contained", "a12_outcome_census", "p4_licence_deed", "r4_select_at_rate"])
def test_queries_against_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "events", "conversations", "pages", "lineitem"):
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    got = registry.queries()[name](spark, small)
    cols = sorted(got.columns)
    mine = sorted(str(tuple(r[c] for c in cols)) for r in got.collect())
    theirs = sorted(str(tuple(r)) for r in con.execute(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from ({registry.oracle_sql()[name]})").fetchall())
    assert mine == theirs


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
