"""The vector index, archives, paged searches and spending, against plain versions, and over restarts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import vectors


def _cosines(rows, k):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    return {i: [int(j) for j in sorted((j for j in range(len(ids)) if ids[j] != ids[i]), key=lambda j: (-round(s[i, j], 9), ids[j]))[:k]] for i in range(len(ids))}


def test_index_finds_what_all_pairs_find(spark, monkeypatch):
    """Exact search over clusters, one of which holds a third of the rows in equal vectors; awkward rows have no neighbours and harm none."""
    monkeypatch.setattr(vectors, "BLOCK", 64)
    monkeypatch.setattr(vectors, "CHUNK", 16)
    rng = np.random.default_rng(1)
    base = rng.normal(size=(6, 8))
    rows = [(i, (base[i % 6] + 0.2 * rng.normal(size=8)).astype(np.float32).tolist()) for i in range(400)] + [(1000 + i, base[0].astype(np.float32).tolist()) for i in range(200)]
    odd = [(None, [1.0] * 8), (5000, None), (5001, []), (5002, [0.0] * 8), (5003, [1.0] * 7), (5004, [float("nan")] * 8), (5005, [None] + [1.0] * 7)]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows + odd], "vec_id long, embedding array<float>, list string, block int")
    index = vectors.build(df, "vec_id", "embedding")
    asked = df.filter("vec_id is null or vec_id % 7 = 0 or vec_id >= 5000")
    got = vectors.search(index, asked, "vec_id", "embedding", k=5, exact=True).collect()
    want = _cosines(rows, 5)
    by = {}
    for r in sorted(got, key=lambda r: (r.query, r.rank)):
        by.setdefault(r.query, []).append((r.id, r.similarity))
    assert set(by) == {i for i, _ in rows if i % 7 == 0}
    x = {i: np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)) for i, v in rows}
    for at, (i, _) in enumerate(rows):
        if i % 7 == 0:
            true = [float(x[i] @ x[rows[j][0]]) for j in want[at]]
            assert len(by[i]) == 5 and np.allclose([s for _, s in by[i]], true) and all(np.isclose(float(x[i] @ x[j]), s) for j, s in by[i])
    some = vectors.recall(vectors.search(index, asked, "vec_id", "embedding", k=5), vectors.search(index, asked, "vec_id", "embedding", k=5, exact=True)).collect()
    assert sum(r.hits for r in some) >= 0.9 * sum(r.wanted for r in some)
    none = vectors.build(df.limit(0), "vec_id", "embedding")
    assert vectors.search(none, df, "vec_id", "embedding").count() == 0 and vectors.search(index, df.limit(0), "vec_id", "embedding", exact=True).count() == 0


def test_index_recall_on_the_given_vectors(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    index, asked = vectors.build(rows, "vec_id", "embedding"), rows.filter("vec_id % 50 = 0")
    got = vectors.recall(*(vectors.search(index, asked, "vec_id", "embedding", exact=e) for e in (False, True))).collect()
    share = sum(r.hits for r in got) / sum(r.wanted for r in got)
    print("recall", share, "probes", index.probes, "of", len(index.centroids))
    assert share >= 0.9


def _zip(path, entries, **kinds):
    import zipfile

    with zipfile.ZipFile(path, "w") as z:
        for name, data in entries:
            z.writestr(name, data, kinds.get(name.split(".")[0], zipfile.ZIP_DEFLATED))


def test_archives_are_read_where_they_lie(spark, tmp_path):
    """Stored and packed members, several archives, member ranges as partitions, line ends, and what can't be read."""
    import zipfile

    from tessera.sources import archives

    long = "".join(f"row {i} é\n" for i in range(30_000))
    _zip(tmp_path / "a.zip", [("one.txt", "a\r\nb\n\nlast"), ("dir/two.txt", long), ("empty.txt", ""), ("dir/", ""), ("skip.bin", b"\xff\xfe\n")], one=zipfile.ZIP_STORED)
    _zip(tmp_path / "b.zip", [(f"m{i}.txt", f"{i}\n" * 5) for i in range(40)])
    _zip(tmp_path / "none.zip", [])
    got = archives.zip_lines(spark, str(tmp_path), members="*.txt", bytes="200")
    assert got.rdd.getNumPartitions() >= 4
    rows = {}
    for r in got.orderBy("archive", "member", "line").collect():
        rows.setdefault((r.archive.rpartition("/")[2], r.member), []).append((r.line, r.value))
    assert rows["a.zip", "one.txt"] == [(0, "a"), (1, "b"), (2, ""), (3, "last")]
    assert [v for _, v in rows["a.zip", "dir/two.txt"]] == long.splitlines() and len(rows) == 42
    assert [r.value for r in archives.zip_lines(spark, f"{tmp_path}/a*.zip", members="*.bin").collect()] == ["��"]
    assert archives.zip_lines(spark, f"file://{tmp_path}/none.zip").count() == 0
    bad = bytearray((tmp_path / "b.zip").read_bytes())
    bad[bad.index(b"m3.txt") + 8] ^= 0xFF  # the packed bytes of one member
    (tmp_path / "c.zip").write_bytes(bytes(bad))
    (tmp_path / "d.zip").write_bytes(b"no archive")
    for name in ("c.zip", "d.zip"):
        with pytest.raises(Exception, match=r"damaged|invalid|zip|Error|incorrect"):
            archives.zip_lines(spark, f"{tmp_path}/{name}").count()
    assert archives.zip_lines(spark, f"{tmp_path}/c.zip,{tmp_path}/d.zip", errors="skip").count() == 39 * 5


def test_annotated_documents_from_an_archive(spark, tmp_path):
    from tessera.sources import archives, files

    text = "11|t|Drug trial\n11|a|Causes harm.\n11\t0\t4\tDrug\tChemical\tD1|D2\n11\t18\t22\tharm\tDisease\tD9\n11\tCID\tD1\tD9\n\n12|t|Other\n12|a|\n"
    (tmp_path / "gold.txt").write_text(text)
    _zip(tmp_path / "gold.zip", [("corpus/train.txt", text), ("readme.md", "x")])
    rows = archives.zip_lines(spark, str(tmp_path / "gold.zip"), members="corpus/*")
    got = archives.span_gold(rows)
    plain = files.span_documents(spark, str(tmp_path / "gold.txt")), files.span_mentions(spark, str(tmp_path / "gold.txt")), files.span_relations(spark, str(tmp_path / "gold.txt"))
    for a, b in zip(got, plain, strict=True):
        assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect())) and a.count()
    assert sorted(r.paper_id for r in archives.paper_ids(rows).collect()) == ["11", "12"]
    archives.check_labels(["O", "B-Chemical"], {0: "O", 1: "B-Chemical"})
    for named in (["O"], ["B-Chemical", "O"]):
        with pytest.raises(ValueError):
            archives.check_labels(named, {0: "O", 1: "B-Chemical"})


def _service(folder, n, fails_at=None):
    """A service of ``n`` results that logs what it is asked for; one page fails until a file says that it may not."""
    from pathlib import Path

    log, flag, size = Path(folder) / "asked", Path(folder) / "failed", Path(folder) / "n"
    size.write_text(str(n))

    def count(query):
        return 200, int(size.read_text())

    def page(query, start, wanted):
        with log.open("a") as f:
            f.write(f"{start}\n")
        if fails_at is not None and start == fails_at and not flag.exists():
            flag.touch()
            return 404, None
        return 200, [(f"{query}-{i}", i * i) for i in range(start, min(start + wanted, int(size.read_text())))]

    return count, page, log, size


def _until(query, done, seconds=90):
    import time

    end = time.time() + seconds
    while time.time() < end and not done():
        if query.exception() is not None:
            break
        time.sleep(0.2)


def test_a_stopped_search_goes_on_at_its_cursor(spark, tmp_path):
    """Stopped, failed in a batch and grown meanwhile: each result once, no committed page again."""
    from tessera.streaming import search

    count, page, log, size = _service(tmp_path, 57, fails_at=30)
    source = search.search_source("fake_search", count, page, "id string, weight long")
    table, checkpoint = str(tmp_path / "table"), str(tmp_path / "cp")
    rows = lambda: spark.read.schema("query string, position long, id string, weight long").parquet(table).collect() if (tmp_path / "table").exists() else []
    run = lambda: search.keep(search.search(spark, source, "q", page=5, requests=2, per_second=50), table, checkpoint)
    q = run()
    _until(q, lambda: False, 60)  # until the failing page ends it
    assert "404" in str(q.exception()) and len(rows()) == 30
    before = log.read_text().split()
    q = run()
    _until(q, lambda: len(rows()) == 57)
    q.stop()
    size.write_text("61")
    q = run()
    _until(q, lambda: len(rows()) == 61)
    q.stop()
    got = sorted(map(tuple, rows()))
    assert got == [("q", i, f"q-{i}", i * i) for i in range(61)]
    asked = [int(x) for x in log.read_text().split()[len(before) :]]
    assert min(asked) == 30 and sorted(set(asked)) == [*range(30, 57, 5), 57]


def test_a_search_keeps_to_its_rate_and_to_its_pages():
    import time

    from tessera.streaming.search import _Cursor

    c = _Cursor("q", lambda q: (200, 1000), lambda q, s, n: (200, [(s,)] * (n - (s == 20))), 10, 3, 20.0)
    assert c.initialOffset() == {"cursor": 0} and c.latestOffset() == {"cursor": 30}
    first = c.partitions({"cursor": 0}, {"cursor": 30})
    assert c.latestOffset() == {"cursor": 60}
    second = c.partitions({"cursor": 30}, {"cursor": 60})
    at = [p.at for p in first + second]
    assert all(b - a > 0.049 for a, b in zip(at, at[1:], strict=False)) and [(p.start, p.end) for p in second] == [(30, 40), (40, 50), (50, 60)]
    began = time.time()
    assert [r[1] for r in c.read(second[0])] == list(range(30, 40)) and time.time() >= second[0].at and time.time() - began < 5
    with pytest.raises(ValueError, match="not 10"):
        list(c.read(first[2]))
    again = _Cursor("q", lambda q: (200, 1000), None, 10, 3, 20.0)
    again.partitions({"cursor": 60}, {"cursor": 90})  # as after a restart
    assert again.latestOffset() == {"cursor": 120}


def test_running_cost_over_restarts(spark, tmp_path):
    """Slices of the table in turn, each by a new start on one checkpoint, against the window over all; repeated and late events don't count."""
    from pyspark.sql import functions as F

    from tessera.plans.registry import queries
    from tessera.streaming import spending

    sf = "/root/testdata/sf0.01"
    charges = spending.cents_of(spark.read.parquet(f"{sf}/events.parquet"))
    folder, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))

    def start(stops, out, cp):
        stream = spark.readStream.schema(charges.schema).parquet(folder)
        spending.running_cost(stream, stops=stops).writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).outputMode("append").trigger(availableNow=True).start().awaitTermination()

    for lo, hi in ((0, 4000), (4000, 7500), (7500, 10_000)):
        charges.filter((F.col("event_id") >= lo) & (F.col("event_id") < hi)).repartition(2).write.mode("append").parquet(folder)
        if hi == 7500:
            charges.filter("event_id < 500").coalesce(1).write.mode("append").parquet(folder)  # again, and late
        start(False, out, cp)
    want = queries()["a22_cumulative_cost"](spark, sf)
    got = spark.read.schema(spending.SCHEMA).parquet(out)
    assert got.exceptAll(want.select(*got.columns)).count() == 0 and got.count() == want.count()
    start(True, str(tmp_path / "let"), str(tmp_path / "cp2"))
    let = spark.read.schema(spending.SCHEMA).parquet(str(tmp_path / "let"))
    assert let.exceptAll(want.filter("not aborted").select(*let.columns)).count() == 0 and let.count() == want.filter("not aborted").count()


def test_a_failed_batch_leaves_one_copy(spark, tmp_path, monkeypatch):
    """Batches that stop before, between and after their writes, then run again; compaction keeps the last writes and can be repeated."""
    from tessera.streaming import logs

    path, cp, come = (str(tmp_path / x) for x in ("log", "cp", "in"))
    rows = lambda lo, hi: spark.range(lo, hi).select((F.col("id") % 7).alias("k"), "id", F.lit("x").alias("_last"))
    say = logs._say
    for i, when in enumerate(("never", "before", "after", "never")):
        rows(i * 50, i * 50 + 50).write.mode("append").parquet(come)
        start = lambda: logs.append(spark.readStream.schema(rows(0, 1).schema).parquet(come), path, cp).awaitTermination()

        def stop(*a, when=when):
            if when == "after":
                say(*a)
            raise RuntimeError("stopped")

        if when != "never":
            with monkeypatch.context() as m:
                m.setattr(logs, "_say", stop)
                with pytest.raises(Exception, match="stopped"):
                    start()
        seen = logs.read(spark, path) if i else None
        assert seen is None or seen.count() == i * 50 + (50 if when == "after" else 0)
        start()
        got = logs.read(spark, path)
        assert sorted(r.id for r in got.collect()) == list(range(i * 50 + 50))
    logs.compact(spark, path, ["k"], ["id"])
    logs.compact(spark, path, ["k"], ["id"])
    got = logs.read(spark, path)
    assert {r.k: r.id for r in got.collect()} == {k: max(i for i in range(200) if i % 7 == k) for k in range(7)} and got.count() == 7
    rows(200, 203).write.mode("append").parquet(come)
    start()
    assert logs.read(spark, path).count() == 10 and logs.last_writes(logs.read(spark, path), ["k"], ["id"]).count() == 7
    assert logs.clean(spark, path) >= 4 and logs.read(spark, path).count() == 10


def test_members_of_large_keys(spark):
    """A key of a million papers has no row larger than a bitmap; negative ids, repeats and small keys come back, pooled ones too."""
    from tessera.operators import pairing

    big = spark.range(-300_000, 700_000).select(F.lit("c").alias("chemical_id"), F.lit("d").alias("disease_id"), (F.col("id") * 3).alias("paper_id"))
    rest = spark.createDataFrame([("x", "y", 1), ("x", "y", 1), ("x", "y", 5), ("one", "y", 2), ("x", "z", None)], "chemical_id string, disease_id string, paper_id long")
    groups = pairing.cluster_members(big.unionByName(rest))
    sizes = groups.select("chemical_id", "n_papers", F.coalesce(F.size("paper_ids"), F.lit(0)).alias("a"), F.coalesce(F.length("bits"), F.lit(0)).alias("b")).collect()
    assert {(r.chemical_id, r.n_papers) for r in sizes} == {("c", 1_000_000), ("x", 2)} and max(r.a for r in sizes) == 2 and max(r.b for r in sizes) == 4096
    back = pairing.members_of(groups)
    want = big.unionByName(rest.filter("chemical_id = 'x' and paper_id is not null").distinct()).select("chemical_id", "disease_id", "paper_id")
    assert back.exceptAll(want).count() == 0 and back.count() == 1_000_002
    a = spark.createDataFrame([("k", "l", i) for i in range(0, 40)] + [("s", "l", 1)], "chemical_id string, disease_id string, paper_id long")
    b = spark.createDataFrame([("k", "l", i) for i in range(35, 42)] + [("s", "l", 2), ("t", "l", 9)], "chemical_id string, disease_id string, paper_id long")
    both = pairing.pooled_members(pairing.cluster_members(a, 1, 10).unionByName(pairing.cluster_members(b, 1, 10)), 10)
    assert sorted(map(tuple, pairing.members_of(both).collect())) == sorted({tuple(r) for r in a.unionByName(b).collect()})
    assert {(r.chemical_id, r.n_papers) for r in both.collect()} == {("k", 42), ("s", 2), ("t", 1)}


def test_display(spark):
    from tessera.functions import display as d

    rows = spark.createDataFrame([(1, "papers", "cc_by_nc_nd", "https://creativecommons.org/licenses/by-nc-nd/3.0/us/", ["A"], "with the question (x, y ,z) kept"), (2, "studies", "cc0", "https://creativecommons.org/publicdomain/zero/1.0/", ["A", "B", "C"], "none"), (1, "studies", None, None, [], None), (1, "mice", "own", "https://creativecommons.org/licenses/by/4.0/legalcode?x#y", None, "with the question ()")], "n int, unit string, token string, url string, authors array<string>, note string")
    got = [tuple(r) for r in rows.select(d.count_of(F.col("n"), F.col("unit")), d.licence_name(F.col("token")), d.deed_name(F.col("url")), d.creators(F.col("authors")), d.question_concepts(F.col("note"))).collect()]
    assert got[0] == ("1 paper", "CC BY-NC-ND", "CC BY-NC-ND 3.0 US", "A", ["x", "y", "z"])
    assert got[1] == ("2 studies", "cc0", "CC0 1.0", "A, B and C", [])
    assert got[2] == ("1 study", "no licence", None, "No authors listed in PubMed", [])
    assert got[3] == ("1 mice", "own", "CC BY 4.0 LEGALCODE", "No authors listed in PubMed", [])


def test_a_report_is_downloaded_in_pieces(spark, tmp_path):
    import gzip
    from pathlib import Path

    from tessera.sources import files, services

    text = "﻿# Report\n# Name\tID\tSynonyms\nAspirin\tD1\ta|b\n" + "".join(f"n{i}\tD{i}\t\n" for i in range(2, 25_000))
    data, flag = gzip.compress(text.encode()), tmp_path / "tried"

    def get(url):
        if not Path(flag).exists():
            Path(flag).touch()
            return 503, []
        return 200, (data[i : i + 1000] for i in range(0, len(data) if url == "whole" else 5000, 1000))

    folder = services.download_report(spark, "whole", get, str(tmp_path / "report"))
    assert files.dictionary(spark, folder, "Name", "ID", "Synonyms").count() == 24_999
    with pytest.raises(Exception, match="ends early"):
        services.download_report(spark, "cut", get, str(tmp_path / "cut"))
