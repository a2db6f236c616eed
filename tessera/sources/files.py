"""Readers of dictionaries, hierarchies, annotated documents and claims. All parsing is in Spark expressions; only a file's
few comment lines come to the driver, to name its columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Identifiers without a prefix get this one.
PREFIX = "MESH:"


def prefixed(raw: Column) -> Column:
    """An identifier with its prefix; blank ones are null."""
    s = F.trim(raw)
    return F.when(s == "", None).when(s.contains(":"), s).otherwise(F.concat(F.lit(PREFIX), s))


def _comments(lines: DataFrame) -> list[str]:
    """The lines that start with ``#``, as they stand in the file."""
    at = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))
    rows = lines.filter(F.col("value").startswith("#")).select("value", at.alias("at")).collect()
    return [r.value.lstrip("#").strip() for r in sorted(rows, key=lambda r: tuple(r["at"]))]


def table_with_comment_header(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """Columns of a tab-separated report whose header is a comment line, named anew by ``columns`` (report name: name).

    The header is the last comment line that holds all the names, wherever it stands; without one this raises.
    Lines too short for a wanted column are left out. A byte order mark on the first line is ignored.
    """
    lines = spark.read.text(path).withColumn("value", F.regexp_replace("value", "^﻿", ""))
    header = None
    for line in _comments(lines):
        names = [n.strip() for n in line.split("\t")]
        if set(columns) <= set(names):
            header = names
    if header is None:
        raise ValueError(f"no comment line in {path} names all of {sorted(columns)}")
    at = {name: header.index(name) for name in columns}
    cells = lines.filter(~F.col("value").startswith("#")).select(F.split("value", "\t", -1).alias("c")).filter(F.size("c") > max(at.values()))
    return cells.select(*[F.trim(F.col("c")[i]).alias(columns[name]) for name, i in at.items()])


def dictionary(spark: SparkSession, path: str, name: str, concept_id: str, synonyms: str) -> DataFrame:
    """``name, concept_id, synonyms`` of a dictionary report; rows with a blank name or id are left out."""
    rows = table_with_comment_header(spark, path, {name: "name", concept_id: "id", synonyms: "all"})
    listed = F.filter(F.transform(F.split("all", r"\|"), lambda s: F.trim(s)), lambda s: s != "")
    return rows.filter("name <> '' and id <> ''").select("name", prefixed(F.col("id")).alias("concept_id"), listed.alias("synonyms"))


def aliases(entries: DataFrame) -> DataFrame:
    """``alias, concept_id, name, is_preferred, ord`` of a dictionary: its names, then their synonyms."""
    every = F.concat(F.array("name"), "synonyms")
    return entries.select("concept_id", "name", F.posexplode(every).alias("ord", "alias")).select("alias", "concept_id", "name", (F.col("ord") == 0).alias("is_preferred"), "ord")


def release_stamp(spark: SparkSession, path: str, marker: str = "Report created:") -> str:
    """What follows ``marker`` in a report's comments; a report without one raises."""
    for line in _comments(spark.read.text(path)):
        if line.startswith(marker):
            return line[len(marker) :].strip()
    raise ValueError(f"no comment line in {path} starts with {marker!r}")


def directions(spark: SparkSession, path: str) -> DataFrame:
    """``pmid, chemical_id, disease_id, evidence`` (sorted, distinct) of the rows that have evidence and papers."""
    names = {"ChemicalID": "chemical", "DiseaseID": "disease", "DirectEvidence": "found", "PubMedIDs": "pmids"}
    rows = table_with_comment_header(spark, path, names).filter("found <> '' and pmids <> ''")
    bare = lambda c: F.regexp_replace(c, "^[A-Za-z]+:", "")
    one = rows.select(F.explode(F.split("pmids", r"\|")).alias("pmid"), bare("chemical").alias("chemical_id"), bare("disease").alias("disease_id"), "found")
    each = one.select(F.trim("pmid").alias("pmid"), "chemical_id", "disease_id", F.explode(F.split("found", r"\|")).alias("e")).filter("pmid <> '' and e <> ''")
    return each.groupBy("pmid", "chemical_id", "disease_id").agg(F.array_sort(F.collect_set(F.trim("e"))).alias("evidence"))


def _xml(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)


def _at_least_one(rows: DataFrame, path: str) -> DataFrame:
    if rows.isEmpty():
        raise ValueError(f"{path} has no records")
    return rows


def tree_numbers(spark: SparkSession, path: str) -> DataFrame:
    """``concept_id, tree_number``, a row for each place of a descriptor; no records raise."""
    rows = _at_least_one(_xml(spark, path, "DescriptorRecord", "DescriptorUI string, TreeNumberList struct<TreeNumber: array<string>>"), path)
    return rows.select(prefixed(F.col("DescriptorUI")).alias("concept_id"), F.explode("TreeNumberList.TreeNumber").alias("tree_number")).filter("concept_id is not null")


def actions(spark: SparkSession, path: str) -> DataFrame:
    """``concept_id, class_id`` of the declared pharmacological actions; no records raise."""
    one = "PharmacologicalAction: array<struct<DescriptorReferredTo: struct<DescriptorUI: string>>>"
    rows = _at_least_one(_xml(spark, path, "DescriptorRecord", f"DescriptorUI string, PharmacologicalActionList struct<{one}>"), path)
    each = rows.select(prefixed(F.col("DescriptorUI")).alias("concept_id"), F.explode("PharmacologicalActionList.PharmacologicalAction.DescriptorReferredTo.DescriptorUI").alias("c"))
    return each.select("concept_id", prefixed(F.col("c")).alias("class_id")).filter("concept_id is not null and class_id is not null").distinct()


def claims(spark: SparkSession, path: str) -> DataFrame:
    """``pmid, question, assertion, kind, text`` of a corpus of claims; each claim holds its own question."""
    rows = _xml(spark, path, "CLAIM", "_PMID string, _QUESTION string, _ASSERTION string, _TYPE string, _VALUE string")
    return rows.select(F.col("_PMID").alias("pmid"), F.col("_QUESTION").alias("question"), F.col("_ASSERTION").alias("assertion"), F.col("_TYPE").alias("kind"), F.trim("_VALUE").alias("text"))


def _fields(rows: DataFrame) -> DataFrame:
    return rows.select(F.split(F.rtrim("value"), "\t", -1).alias("c"))


def _ids(raw: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(raw, r"\|"), lambda s: prefixed(s)), lambda s: s.isNotNull() & (s != PREFIX + "-1")))


def span_mentions(spark: SparkSession, path: str, labels: tuple[str, ...] = ("Chemical", "Disease")) -> DataFrame:
    """``paper_id, start, end, text, label, concept_ids`` of lines with six fields or more and a known label."""
    return mentions_of(spark.read.text(path), labels)


def mentions_of(rows: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """As ``span_mentions``, of rows that hold a line in ``value``."""
    rows = _fields(rows).filter((F.size("c") >= 6) & F.col("c")[3].isNotNull() & F.col("c")[4].isin(*labels))
    return rows.select(F.col("c")[0].alias("paper_id"), F.col("c")[1].cast("int").alias("start"), F.col("c")[2].cast("int").alias("end"), F.col("c")[3].alias("text"), F.upper(F.col("c")[4]).alias("label"), _ids(F.col("c")[5]).alias("concept_ids"))


def span_relations(spark: SparkSession, path: str, kind: str = "CID") -> DataFrame:
    """``paper_id, chemical_id, disease_id``, distinct, of lines of exactly four fields whose second is ``kind``."""
    return relations_of(spark.read.text(path), kind)


def relations_of(rows: DataFrame, kind: str) -> DataFrame:
    """As ``span_relations``, of rows that hold a line in ``value``."""
    rows = _fields(rows).filter((F.size("c") == 4) & (F.col("c")[1] == kind))
    left = rows.select(F.col("c")[0].alias("paper_id"), F.explode(_ids(F.col("c")[2])).alias("chemical_id"), F.col("c")[3].alias("d"))
    return left.select("paper_id", "chemical_id", F.explode(_ids(F.col("d"))).alias("disease_id")).distinct()


def span_documents(spark: SparkSession, path: str) -> DataFrame:
    """``paper_id, text``: a title and its abstract with a blank between, which the offsets of the mentions count in."""
    return documents_of(spark.read.text(path))


def documents_of(rows: DataFrame) -> DataFrame:
    """As ``span_documents``, of rows that hold a line in ``value``."""
    part = rows.select(F.regexp_extract("value", r"^([^|\t]+)\|[ta]\|", 1).alias("paper_id"), F.regexp_extract("value", r"^[^|\t]+\|([ta])\|", 1).alias("part"), F.regexp_replace("value", r"^[^|\t]+\|[ta]\|", "").alias("said")).filter("paper_id <> ''")
    one = lambda p: F.max(F.when(F.col("part") == p, F.col("said")))
    return part.groupBy("paper_id").agg(F.concat_ws(" ", one("t"), one("a")).alias("text"))


def tagged_spans(rows: DataFrame, key: str = "sentence_id", tokens: str = "tokens", tags: str = "tags") -> DataFrame:
    """``key, start, end, text, label`` from token tags (B-x opens, I-x goes on, anything else closes).

    Tokens stand with one blank between. An I-x that doesn't go on a span of its label opens one.
    """
    order = Window.partitionBy(key).orderBy("pos")
    each = rows.select(key, F.posexplode(F.arrays_zip(F.col(tokens).alias("tok"), F.col(tags).alias("tag"))).alias("pos", "z")).select(key, "pos", "z.tok", F.when(F.col("z.tag").rlike("^[BI]-."), F.col("z.tag")).alias("tag"))
    each = each.withColumn("end", (F.sum(F.length("tok") + 1).over(order) - 1).cast("int")).withColumn("start", F.col("end") - F.length("tok"))
    each = each.withColumn("label", F.substring("tag", 3, 1 << 20))
    opens = F.col("tag").startswith("B-") | ~F.lag("label").over(order).eqNullSafe(F.col("label"))
    each = each.withColumn("run", F.sum(F.coalesce(opens, F.lit(True)).cast("int")).over(order)).filter("label is not null")
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tok"))), lambda x: x.tok), " ")
    return each.groupBy(key, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), words.alias("text"), F.first("label").alias("label")).drop("run")


def gold_sentences(spark: SparkSession, path: str, labels: tuple[str, ...] = ("CHEMICAL", "DISEASE")) -> DataFrame:
    """A row per annotated mention of JSON lines; a bad bound, label or surface raises as the row is read."""
    entity = "start int, end int, label string, text string, mesh_id string".replace(" int", ": int").replace(" string", ": string")
    rows = spark.read.schema(f"paper_id string, sentence_index int, text string, entities array<struct<{entity}>>").json(path)
    each = rows.select("paper_id", "sentence_index", F.col("text").alias("sentence"), F.explode_outer("entities").alias("e")).select("paper_id", "sentence_index", "sentence", "e.*")
    inside = (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.length("sentence"))
    right = F.col("label").isin(*labels) & inside & (F.expr("substring(sentence, start + 1, end - start)") == F.col("text"))
    said = F.concat_ws(" ", F.lit("bad mention in"), "paper_id", "sentence_index", "text")
    none = F.col("start").isNull() & F.col("end").isNull() & F.col("label").isNull()
    return each.withColumn("text", F.when(none | F.coalesce(right, F.lit(False)), F.col("text")).otherwise(F.raise_error(said)))
