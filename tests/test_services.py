"""Service responses, saved state, annotation sheets and text windows on small invented files."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import evidence, providers, windows
from tessera.sources import services, state

ARTICLES = """<?xml version="1.0"?>
<PubmedArticleSet>
<PubmedArticle><MedlineCitation><PMID>11</PMID><Article><Journal><JournalIssue><PubDate><Year>2001</Year></PubDate></JournalIssue><Title>J One</Title></Journal>
<ArticleTitle>On <i>x</i> and y</ArticleTitle><Abstract><AbstractText Label="AIM">First <b>part</b>.</AbstractText><AbstractText/><AbstractText Label="END"> Last. </AbstractText></Abstract>
<AuthorList><Author><LastName>Doe</LastName><ForeName>A B</ForeName></Author><Author><CollectiveName>The Group</CollectiveName></Author><Author><Initials>Q</Initials></Author></AuthorList></Article></MedlineCitation>
<PubmedData><ArticleIdList><ArticleId IdType="doi">10.1/a</ArticleId><ArticleId IdType="pmc">pmc77</ArticleId></ArticleIdList><ReferenceList><Reference><ArticleIdList><ArticleId IdType="doi">10.9/other</ArticleId></ArticleIdList></Reference></ReferenceList></PubmedData></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID>12</PMID><Article><Journal><JournalIssue><PubDate><MedlineDate>1998 May</MedlineDate></PubDate></JournalIssue></Journal><ArticleTitle>Plain</ArticleTitle></Article></MedlineCitation>
<PubmedData><ReferenceList><Reference><ArticleIdList><ArticleId IdType="doi">10.9/other</ArticleId></ArticleIdList></Reference></ReferenceList></PubmedData></PubmedArticle>
</PubmedArticleSet>
"""


@pytest.fixture
def put(tmp_path):
    def write(name, text):
        (tmp_path / name).write_text(text, encoding="utf-8")
        return str(tmp_path / name)

    return write


def test_articles(spark, put):
    a, b = sorted(services.articles(spark, put("a.xml", ARTICLES)).collect(), key=lambda r: r.pmid)
    assert (a.paper_id, a.pmcid, a.title, a.abstract, a.journal, a.year) == ("10.1/a", "77", "On x and y", "AIM: First part.\nEND: Last.", "J One", 2001)
    assert [x.name for x in a.authors] == ["A B Doe", "The Group"]
    assert (b.paper_id, b.doi, b.abstract, b.year, b.authors) == ("12", None, None, None, [])
    assert sorted((r.pmid, r.abstract is None) for r in services.abstracts(spark, put("b.xml", ARTICLES)).collect()) == [("11", False), ("12", True)]


def test_permissions(spark, put):
    body = """<set><article><front><article-id pub-id-type="pmcid">PMC77</article-id><article-id pub-id-type="pmcid-ver">PMC77.1</article-id><license xlink:href="http://b"><ali:license_ref>http://a</ali:license_ref></license></front></article>
<article><front><article-id pub-id-type="pmcid">78</article-id><license license-type="x" xlink:href="http://b"/></front></article><article><article-id pub-id-type="pmcid">79</article-id></article><article>broken"""
    p = services.permissions(spark, put("p.xml", body))
    assert {(r.pmcid, r.license) for r in p.collect()} == {("77", "http://a"), ("78", "http://b"), ("79", None)}
    assert services.with_permissions(services.articles(spark, put("a.xml", ARTICLES)), p).filter("license is not null").count() == 1


def test_search(spark):
    body = '<eSearchResult><IdList><Id>3</Id><Id>1</Id></IdList><TranslationSet><Translation><From>x</From><To>"b"[MeSH Terms] OR "a"[All Fields] OR "b"[T]</To></Translation></TranslationSet></eSearchResult>'
    r = services.search_results(spark.createDataFrame([(body,)], "body string")).first()
    assert (r.ids, r.terms) == (["3", "1"], ["b", "a"])


def test_preprints(spark, put):
    body = '{"collection": [{"doi": "10.1/p", "title": "T", "authors": "Doe, A.; Roe, B.;", "date": "2020-01-02", "license": "cc_by", "abstract": "NA", "server": "medRxiv"}, {"doi": "10.1/q", "title": " ", "authors": "NA", "date": "n.d.", "license": "NA", "server": "other"}]}'
    got = {r.doi: (r.title, r.abstract, r.authors, r.year, r.license, r.server) for r in services.preprints(spark, put("p.json", body)).collect()}
    assert got == {"10.1/p": ("T", None, ["Doe, A.", "Roe, B."], 2020, "cc_by", "medrxiv"), "10.1/q": (None, None, [], None, None, "biorxiv")}


def test_retries_end():
    answers = [(503, ""), (429, ""), (200, "ok")]
    waits = []
    assert services.with_retry(lambda: answers.pop(0), waits.append, lambda: 1.0) == "ok" and waits == [0.5, 1.0]
    for status, tries in ((404, 1), (500, 5)):
        seen = []
        with pytest.raises(OSError):
            services.with_retry(lambda status=status, seen=seen: (seen.append(1), (status, ""))[1], lambda _: None)
        assert len(seen) == tries


def test_fetch_runs_on_executors(spark):
    urls = spark.createDataFrame([("u1",), ("u2",)], "url string")
    assert {(r.url, r.body) for r in services.fetch(urls, lambda u: (200, u.upper())).collect()} == {("u1", "U1"), ("u2", "U2")}


def test_pooled_runs_merge_by_key(spark):
    runs = spark.createDataFrame([("k", [2, 1]), ("k", [2, 3]), ("j", [5])], "key string, paper_ids array<long>")
    assert {(r.key, tuple(r.paper_ids)) for r in state.pooled(runs).collect()} == {("k", (1, 2, 3)), ("j", (5,))}


def test_runs_of_sided_keys_are_pooled_in_one_exchange(spark, monkeypatch):
    monkeypatch.setattr(state, "LEFT_ROWS", 4)
    rows = [(1, p, list(range(p % 5 + 1))) for p in range(30)] + [(1, 3, [0, 9]), (2, 7, [0]), (2, 7, [0, 1])]
    runs = spark.createDataFrame(rows, "left int, paper_id long, rights array<int>")
    pooled = state.pooled_sides(runs, runs.groupBy("left").count().withColumnRenamed("count", "n"))
    want = {}
    for a, p, some in rows:
        for b in some:
            want.setdefault((a, b), set()).add(p)
    got = pooled.collect()
    assert len(got) == len(want) and {(r.left, r.right): r.paper_ids for r in got} == {k: sorted(v) for k, v in want.items()}
    assert pooled._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 1


def test_arms_must_agree(spark, put):
    line = '{"dataset": "d", "arm": "%s", "members": [%s]}\n'
    one, two = '{"paper_id": "1", "sentence_index": 0}', '{"paper_id": "2", "sentence_index": 4}'
    path = put("log.jsonl", line % ("x", f"{one}, {two}") + line % ("x", f"{two}, {one}") + line % ("y", one) + line % ("y", two))
    assert {(r.paper_id, r.sentence_index) for r in state.arm_of(spark, path, "d", "x").collect()} == {("1", 0), ("2", 4)}
    for arm in ("y", "z"):
        with pytest.raises(ValueError):
            state.arm_of(spark, path, "d", arm)


def test_sheets_come_back(spark, put):
    rows = spark.createDataFrame([("r1", "C", "one", "two"), ("r2", "C", "three", "four")], "row_id string, concept_id string, text_a string, text_b string")
    names = spark.createDataFrame([("C", "name of C")], "concept_id string, name string")
    blocks = state.sheet(rows, names, "s").orderBy("number").collect()
    assert [b.number for b in blocks] == [1, 2] and all("name of C" in b.block and b.row_id not in b.block for b in blocks)
    filled = "# Sheet\n\n" + "\n\n".join(b.block.replace("label:", "label: Agreement").replace("reason:", "reason: so") for b in blocks)
    assert sorted((r.row_id, r.label, r.reason) for r in state.annotations(spark, put("s.md", filled), ("agreement",)).collect()) == [("1", "agreement", "so"), ("2", "agreement", "so")]
    with pytest.raises(Exception, match="no known label at 1"):
        state.annotations(spark, put("t.md", "## 1\nlabel: maybe\n"), ("agreement",)).collect()
    with pytest.raises(Exception, match="no name for"):
        state.sheet(rows.withColumn("concept_id", F.lit("D")), names, "s").collect()


def test_artifacts_and_runs_are_kept(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a"])], "k long, v array<string>")
    state.save_artifact(df, f"{tmp_path}/a")
    assert state.load_artifact(spark, f"{tmp_path}/a").collect() == df.collect() == state.save_then_show(df, f"{tmp_path}/r").collect()
    s = spark.createDataFrame([("b", 3), ("a", 3), ("c", 9)], "query_id string, n_clusters long")
    assert [r.line for r in state.frozen(s).collect()] == ['{"query_id":"c","n_clusters":9}', '{"query_id":"a","n_clusters":3}', '{"query_id":"b","n_clusters":3}']


def words(t):
    return len(t.split())


def test_windows_cover_all_within_budget():
    text = "a b c. d e. " + "f " * 12 + "g. h i. j."
    ends, at = [], 0
    for part in ("a b c.", "d e.", ("f " * 12 + "g.").strip(), "h i.", "j."):
        at = text.index(part, at)
        ends.append((at, at + len(part)))
        at += len(part)
    got = windows.plan(text, ends, words, 5)
    assert all(words(text[a:b]) <= 5 for a, b in got) and got[0] == (0, 11)
    assert {i for a, b in got for i in range(a, b)} >= {i for a, b in ends for i in range(a, b) if text[i] != " "}
    assert windows.plan("a. b. c. d.", [(0, 2), (3, 5), (6, 8), (9, 11)], words, 2) == [(0, 5), (3, 8), (6, 11)]
    assert windows.plan("x" * 10, [(0, 10)], len, 4) == [(0, 4), (4, 8), (8, 10)]
    assert windows.plan("", [(0, 0)], words, 3) == [(0, 0)] and windows.plan("a", [], words, 3) == []


def test_best_spans(spark):
    rows = spark.createDataFrame([(1, "A", 0, 5, 0, 0.5), (1, "A", 0, 5, 1, 0.9), (1, "A", 1, 3, 0, 1.0), (1, "B", 1, 3, 0, 0.1)], "paper_id long, label string, start int, end int, window int, score double")
    assert {(r.label, r.start, r.end, r.window) for r in windows.best_spans(rows).collect()} == {("A", 0, 5, 1), ("B", 1, 3, 0)}


def test_published_hides_unlicensed_findings(spark):
    ranked = spark.createDataFrame([(1, "C|D", 1, float("inf"))], "query_id long, key string, rank int, proximity double")
    clusters = spark.createDataFrame([("C|D", "C", "D")], "key string, chemical_id string, disease_id string")
    members = spark.createDataFrame([("C|D", 7), ("C|D", 8), ("C|D", 9)], "key string, paper_id long")
    papers = spark.createDataFrame([(7, True), (8, False), (9, True)], "paper_id long, extraction_allowed boolean")
    found = spark.createDataFrame([(7,), (8,)], "paper_id long")
    names = spark.createDataFrame([("C", "cee")], "concept_id string, name string")
    got = {(r.title, r.paper_id, r.proximity, r.excerpted) for r in evidence.published(ranked, clusters, members, papers, found, names).collect()}
    assert got == {("cee / D", 7, None, True), ("cee / D", 8, None, False), ("cee / D", 9, None, False)}


def test_providers_report_refusals_and_errors(spark):
    rows = spark.createDataFrame([(1, 0, "a."), (1, 1, "b."), (2, 0, "no."), (3, 0, "bad.")], "paper_id long, sentence_index int, text string")

    def choose(prompt):
        if "bad" in prompt:
            raise KeyError(prompt)
        return None if "no" in prompt else [1, 1, 0, 7]

    got = {r.paper_id: (r.indices, r.out_of_range, r.status) for r in providers.extracted(rows, choose).collect()}
    assert got == {1: ([0, 1], 1, "ok"), 2: ([], 0, "refused"), 3: ([], 0, "error: KeyError")}
    pairs = spark.createDataFrame([(1, "x", "x"), (2, "x", "y"), (3, "x", "")], "k long, text_a string, text_b string")
    assert {(r.k, r.verdict) for r in providers.judged_by(pairs, lambda a, b: "agreement" if a == b else ("what" if b else None)).collect()} == {(1, "agreement"), (2, None), (3, None)}
