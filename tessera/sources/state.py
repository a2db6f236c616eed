"""Saved artifacts, pooled runs, run logs and annotation sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def save_artifact(rows: DataFrame, path: str) -> None:
    """Keep a derived table (dictionary, hierarchy, classes) without loss."""
    rows.write.mode("errorifexists").parquet(path)


def load_artifact(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def pooled(runs: DataFrame) -> DataFrame:
    """``key, paper_ids`` over saved runs: one row a key, with the union of its papers."""
    each = runs.select("key", F.explode("paper_ids").alias("p")).distinct()
    return each.groupBy("key").agg(F.sort_array(F.collect_list("p")).alias("paper_ids"))


#: Rows of a left side that are grouped in one task.
LEFT_ROWS = 50_000


def pooled_sides(runs: DataFrame, sizes: DataFrame) -> DataFrame:
    """:func:`pooled` for keys of two sides: ``left, right, paper_ids`` from ``left, paper_id, rights``, each row with all that a paper pairs with the left side.

    Rows are dealt once, by their left side; so a key's paper travels as one element of an array. ``sizes`` has ``left, n``, about how many rows a left side has:
    one of more than ``LEFT_ROWS`` is dealt into several buckets by its right sides.
    """
    large = sizes.filter(F.col("n") > LEFT_ROWS).select(F.col("left").alias("_l"), F.ceil(F.col("n") / LEFT_ROWS).cast("int").alias("_n"))
    many = F.coalesce("_n", F.lit(1))
    each = runs.join(F.broadcast(large), F.col("left") == F.col("_l"), "left").select("left", "paper_id", "rights", many.alias("_n"))
    each = each.select("left", "paper_id", "rights", "_n", F.explode(F.when(F.col("_n") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("_n") - 1))).alias("_b"))
    mine = F.when(F.col("_n") == 1, F.col("rights")).otherwise(F.filter("rights", lambda r: F.pmod(F.hash(r), F.col("_n")) == F.col("_b")))
    dealt = each.select("left", "_b", "paper_id", mine.alias("rights")).repartition("left", "_b")
    grouped = dealt.select("left", "_b", "paper_id", F.explode("rights").alias("right")).groupBy("left", "_b", "right").agg(F.collect_list("paper_id").alias("p"))
    return grouped.select("left", "right", F.sort_array(F.array_distinct("p")).alias("paper_ids"))


def arm_of(spark: SparkSession, path: str, dataset: str, arm: str) -> DataFrame:
    """``paper_id, sentence_index`` that an arm chose, from a log of JSON lines (dataset, arm, members).

    No line of the dataset and arm, or lines that disagree, raise.
    """
    member = "array<struct<paper_id: string, sentence_index: int>>"
    log = spark.read.schema(f"dataset string, arm string, members {member}").json(path).filter((F.col("dataset") == dataset) & (F.col("arm") == arm))
    kinds = log.select(F.md5(F.to_json(F.array_sort(F.array_distinct("members")))).alias("m")).distinct().limit(2).count()
    if kinds != 1:
        raise ValueError(f"{path}: {'no line' if kinds == 0 else 'disagreeing lines'} of {arm} on {dataset}")
    return log.select(F.explode("members").alias("m")).select("m.*").distinct()


def annotations(spark: SparkSession, path: str, allowed: tuple[str, ...]) -> DataFrame:
    """``row_id, label, reason`` of a filled-in sheet: blocks begin with a heading ``## <id>`` and have a line ``label:``.

    A missing or unknown label raises when read.
    """
    blocks = spark.read.text(path, wholetext=True).select(F.explode(F.filter(F.split("value", r"(?m)^## +"), lambda b: b.rlike(r"(?m)^label:"))).alias("b"))
    label = F.lower(F.trim(F.regexp_extract("b", r"(?m)^label:[ \t]*(.*)$", 1)))
    row = F.regexp_extract("b", r"^(\S+)", 1)
    checked = F.when(label.isin(*allowed), label).otherwise(F.raise_error(F.concat(F.lit("no known label at "), row)))
    return blocks.select(row.alias("row_id"), checked.alias("label"), F.trim(F.regexp_extract("b", r"(?m)^reason:[ \t]*(.*)$", 1)).alias("reason"))


def sheet(rows: DataFrame, names: DataFrame, seed: str) -> DataFrame:
    """``number, row_id, block``: a blind sheet of ``row_id, concept_id, text_a, text_b``, in seeded order, numbered after it.

    It shows one concept by name and no ids of papers or groups; a concept without a name raises. A sheet is read by
    people, so one task orders it.
    """
    named = rows.join(names.select("concept_id", F.col("name").alias("_name")), "concept_id", "left")
    shown = F.coalesce("_name", F.raise_error(F.concat(F.lit("no name for "), "concept_id")))
    number = F.row_number().over(Window.orderBy(F.md5(F.concat_ws("|", F.lit(seed), "row_id")), "row_id"))
    block = F.concat_ws("\n", F.concat(F.lit("## "), F.col("number").cast("string")), F.concat(F.lit("concept: "), shown), F.concat(F.lit("A: "), "text_a"), F.concat(F.lit("B: "), "text_b"), F.lit("label:"), F.lit("reason:"))
    return named.withColumn("number", number).select("number", "row_id", block.alias("block"))


def frozen(screened: DataFrame) -> DataFrame:
    """``line``: a screen as JSON lines, most groups first."""
    return screened.orderBy(F.desc("n_clusters"), "query_id").select(F.to_json(F.struct(*screened.columns)).alias("line"))


def save_then_show(rows: DataFrame, path: str, n: int = 20) -> DataFrame:
    """Write a run, then show the head of what was written, so that a failing console loses nothing."""
    rows.write.mode("errorifexists").parquet(path)
    saved = rows.sparkSession.read.parquet(path)
    saved.show(n, truncate=False)
    return saved
