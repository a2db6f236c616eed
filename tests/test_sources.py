"""Readers, writers and incremental ingest on small files."""

import json

import pytest

from tessera.sources import files, sinks
from tessera.streaming import ingest


@pytest.fixture
def put(tmp_path):
    def write(name, text):
        p = tmp_path / name
        p.write_text(text, encoding="utf-8")
        return str(p)

    return write


def rows(df):
    return sorted((tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in df.collect()), key=str)


def test_dictionary(spark, put):
    body = "# made up\n# Name\tId\tNote\tSyn\n#\nAlpha\tM1\tn\tA1|A2\n\tM2\tn\tx\nBeta\tOM:7\tn\t\nGamma\tM3\nDelta\t\tn\tq\n"
    got = files.dictionary(spark, put("d.tsv", body), "Name", "Id", "Syn")
    assert rows(got) == [("Alpha", "MESH:M1", ("A1", "A2")), ("Beta", "OM:7", ())]
    assert rows(files.aliases(got).select("alias", "concept_id", "is_preferred")) == [("A1", "MESH:M1", False), ("A2", "MESH:M1", False), ("Alpha", "MESH:M1", True), ("Beta", "OM:7", True)]
    with pytest.raises(ValueError):
        files.dictionary(spark, put("none.tsv", "Alpha\tM1\tn\tx\n"), "Name", "Id", "Syn")


def test_directions_and_stamp(spark, put):
    path = put("r.tsv", "# Report created: a day\n# ChemicalID\tDiseaseID\tDirectEvidence\tPubMedIDs\n#\nC1\tMESH:D1\tx|y\t1|2\nC1\tMESH:D1\tx\t1\nC2\tMESH:D1\t\t3\nC3\tMESH:D1\tx\t\n")
    assert rows(files.directions(spark, path)) == [("1", "C1", "D1", ("x", "y")), ("2", "C1", "D1", ("x", "y"))]
    assert files.release_stamp(spark, path) == "a day"
    with pytest.raises(ValueError):
        files.release_stamp(spark, put("n.tsv", "# nothing\n"))


def test_hierarchy_xml(spark, put):
    act = "<PharmacologicalActionList><PharmacologicalAction><DescriptorReferredTo><DescriptorUI>K1</DescriptorUI></DescriptorReferredTo></PharmacologicalAction></PharmacologicalActionList>"
    one = f"<DescriptorRecord><DescriptorUI>A</DescriptorUI><SeeRelatedList><DescriptorReferredTo><DescriptorUI>Z</DescriptorUI></DescriptorReferredTo></SeeRelatedList>{act}<TreeNumberList><TreeNumber>C1.2</TreeNumber><TreeNumber>C4</TreeNumber></TreeNumberList></DescriptorRecord>"
    path = put("m.xml", f"<S>{one}<DescriptorRecord><DescriptorUI>B</DescriptorUI></DescriptorRecord></S>")
    assert rows(files.tree_numbers(spark, path)) == [("MESH:A", "C1.2"), ("MESH:A", "C4")]
    assert rows(files.actions(spark, path)) == [("MESH:A", "MESH:K1")]
    with pytest.raises(ValueError):
        files.tree_numbers(spark, put("e.xml", "<S></S>"))


def test_claims(spark, put):
    path = put("c.xml", '<R><REVIEW><CLAIM PMID="1" QUESTION="q" ASSERTION="YS" TYPE="t"> It helps. </CLAIM><CLAIM PMID="2" QUESTION="q" ASSERTION="NO" TYPE="t">No.</CLAIM></REVIEW></R>')
    assert rows(files.claims(spark, path)) == [("1", "q", "YS", "t", "It helps."), ("2", "q", "NO", "t", "No.")]


def test_span_files(spark, put):
    path = put("p.txt", "7|t|Ab helps.\n7|a|Ab for cd.\n7\t0\t2\tAb\tChemical\tD1|D2|-1\n7\t17\t19\tcd\tDisease\t-1\n7\t1\t2\tq\tGene\tX\n7\tCID\tD1\tD9\n\n8|t|T\n8|a|\n")
    assert rows(files.span_documents(spark, path)) == [("7", "Ab helps. Ab for cd."), ("8", "T ")]
    assert rows(files.span_mentions(spark, path)) == [("7", 0, 2, "Ab", "CHEMICAL", ("MESH:D1", "MESH:D2")), ("7", 17, 19, "cd", "DISEASE", ())]
    assert rows(files.span_relations(spark, path)) == [("7", "MESH:D1", "MESH:D9")]


def test_tagged_spans(spark):
    tokens = ["a", "bb", "c", "d", "ee", "f"]
    data = [(1, tokens, ["B-X", "I-X", "B-X", "O", "I-Y", "I-Y"]), (2, tokens, ["B-X", "I-Y", "?", "I-Y", "O", "B-X"]), (3, [], [])]
    got = rows(files.tagged_spans(spark.createDataFrame(data, "sentence_id int, tokens array<string>, tags array<string>")))
    assert got == sorted([(1, 0, 4, "a bb", "X"), (1, 5, 6, "c", "X"), (1, 9, 13, "ee f", "Y"), (2, 0, 1, "a", "X"), (2, 2, 4, "bb", "Y"), (2, 7, 8, "d", "Y"), (2, 12, 13, "f", "X")], key=str)


def test_gold_sentences(spark, put):
    line = lambda e: json.dumps({"paper_id": "p", "sentence_index": 0, "text": "Ab cd", "entities": e}) + "\n"
    good = {"start": 3, "end": 5, "label": "DISEASE", "text": "cd", "mesh_id": "D1"}
    assert files.gold_sentences(spark, put("g.jsonl", line([good]) + line([]))).count() == 2
    for i, bad in enumerate(({"end": 9}, {"text": "xx"}, {"label": "GENE"}, {"start": None})):
        with pytest.raises(Exception, match="bad mention"):
            files.gold_sentences(spark, put(f"b{i}.jsonl", line([good | bad]))).collect()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", 2), ("a", 1)], "k string, v int")
    for _ in range(2):
        sinks.append_log(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    sinks.write_manifest(df, str(tmp_path / "m"), ["k"])
    assert [(r.k, r.ord) for r in sinks.read_manifest(spark, str(tmp_path / "m")).collect()] == [("a", 1), ("b", 2)]
    assert json.loads(sinks.schema_json(df))["fields"][0]["name"] == "k"


def test_ingest_takes_each_file_once(spark, tmp_path):
    folder, table, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()
    schema = "paper_id long, abstract string, extraction_allowed boolean"
    for n in (1, 2):
        (folder / f"{n}.json").write_text(f'{{"paper_id":{n},"abstract":"x","extraction_allowed":true}}\n{{"paper_id":{n + 10},"extraction_allowed":false}}\n{{"paper_id":{n + 20}}}\n')
        ingest.ingest(ingest.papers_stream(spark, str(folder), schema), table, state).awaitTermination(120)
    assert sorted(r.paper_id for r in spark.read.parquet(table).collect()) == [1, 2]
