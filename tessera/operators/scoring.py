"""Evaluation: multiset and set scores, censuses, confusions, sampling and baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import prf, ratio
from ..functions.text import seeded_uniform
from .spans import overlap_counts


def _scores(counts: DataFrame, keep: list[str]) -> DataFrame:
    p, r, f = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return counts.select(*keep, "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f.alias("f1"))


def multiset_scores(gold: DataFrame, predicted: DataFrame, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """Micro scores where a row counts as often as it occurs."""
    g, p = gold.groupBy(*keys).agg(F.count("*").alias("g")), predicted.groupBy(*keys).agg(F.count("*").alias("p"))
    both = g.join(p, keys, "full_outer").na.fill(0, ["g", "p"])
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    agg = both.groupBy(*(by or [])).agg(total(F.least("g", "p")).alias("tp"), total(F.greatest(F.col("p") - F.col("g"), F.lit(0))).alias("fp"), total(F.greatest(F.col("g") - F.col("p"), F.lit(0))).alias("fn"))
    return _scores(agg, by or [])


def set_scores(gold: DataFrame, predicted: DataFrame, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """Micro scores of distinct rows."""
    return multiset_scores(gold.select(*keys).distinct(), predicted.select(*keys).distinct(), keys, by)


def tallied(rows: DataFrame, gold: Column, predicted: Column, by: list[str] | None = None, weight: Column | None = None) -> DataFrame:
    """As :func:`set_scores`, of distinct rows that say themselves what they are: nothing is joined."""
    n = F.lit(1) if weight is None else weight
    total = lambda c: F.coalesce(F.sum(F.when(c, n)), F.lit(0)).cast("long")
    return _scores(rows.groupBy(*(by or [])).agg(total(gold & predicted).alias("tp"), total(~gold & predicted).alias("fp"), total(gold & ~predicted).alias("fn")), by or [])


def census(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Each gold span's outcome: EXACT, MERGEABLE (two overlaps or more), TRUNCATED (one) or MISSED, within document and label."""
    each = overlap_counts(gold, predicted, ["paper_id", "label"]).withColumn("exact", F.col("equal") > 0).drop("equal")
    return each.withColumn("outcome", F.when(F.col("exact"), "EXACT").when(F.col("n") >= 2, "MERGEABLE").when(F.col("n") == 1, "TRUNCATED").otherwise("MISSED"))


def confusion(pairs: DataFrame, labels: list, gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """Dense confusion counts, zero cells included."""
    spark = pairs.sparkSession
    cells = spark.createDataFrame([(a, b) for a in labels for b in labels], f"{gold} int, {predicted} int")
    return cells.join(pairs.groupBy(gold, predicted).agg(F.count("*").alias("n")), [gold, predicted], "left").na.fill(0, ["n"])


def macro_f1(matrix: DataFrame, gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """Mean F1 over all classes, and each class's scores and specificity, from a dense confusion."""
    total = matrix.agg(F.sum("n").alias("all"))
    rows, cols = matrix.groupBy(F.col(gold).alias("label")).agg(F.sum("n").alias("g")), matrix.groupBy(F.col(predicted).alias("label")).agg(F.sum("n").alias("p"))
    hit = matrix.filter(F.col(gold) == F.col(predicted)).select(F.col(gold).alias("label"), F.col("n").alias("tp"))
    x = rows.join(cols, "label").join(hit, "label").join(total)
    x = x.select("label", "tp", (F.col("p") - F.col("tp")).alias("fp"), (F.col("g") - F.col("tp")).alias("fn"), (F.col("all") - F.col("g") - F.col("p") + F.col("tp")).alias("tn"))
    return _scores(x, ["label", "tn"]).withColumn("specificity", ratio(F.col("tn"), F.col("tn") + F.col("fp")))


def stratified(rows: DataFrame, stratum: str, n: int, seed: str, *key: str) -> DataFrame:
    """``n`` rows of each stratum in seeded hash order."""
    draw = F.md5(F.concat_ws("|", F.lit(seed), *key))
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(stratum).orderBy(draw, *key))).filter(F.col("_rn") <= n).drop("_rn")


def at_rate(rows: DataFrame, rate: float, seed: str, *key: str) -> DataFrame:
    """Each row by an independent seeded draw."""
    return rows.filter(seeded_uniform(F.lit(seed), *[F.col(k).cast("string") for k in key]) < rate)


def content_hash(rows: DataFrame, *columns: str, digits: int = 16) -> DataFrame:
    """A digest that depends on no order of rows: of their number and of the sums of four parts of each row's own digest.

    Sums are partial aggregates, so a table of any size meets as one row a task.
    """
    row = F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]), 256)
    parts = [F.coalesce(F.sum(F.conv(F.substring("d", at, 12), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("string") for at in (1, 13, 25, 37)]
    return rows.select(row.alias("d")).agg(F.substring(F.sha2(F.concat_ws("|", F.count("*").cast("string"), *parts), 256), 1, digits).alias("content_hash"))


def top_errors(errors: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The ``n`` most frequent errors, ties by key. Counts are partial sums, and each task sends its own first ``n``."""
    return errors.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *keys).limit(n)
