"""Connected components of a link table by alternating large-star and small-star steps, cut to the shared folder each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cut


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One step over rows (u, v) with u > v: each node hangs its larger (or smaller) neighbours on its least one."""
    if large:
        near = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = links
    # the least neighbour is a partial aggregate, so a hub's neighbours never meet in one task
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = near.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u > v").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links`` (a, b: long), component being the least node reachable.

    Links may repeat and point either way; loops and nulls are left out. Rounds go on until no link changes.
    """
    pair = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    now = Cut(pair)
    sign = _sign(now.df)
    while sign[0]:
        after = Cut(_star(_star(now.df, True), False))
        now.drop()
        now, before, sign = after, sign, _sign(after.df)
        if sign == before:
            break
    roots = now.df.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.df.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _sign(links: DataFrame) -> tuple:
    r = links.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
    return (r.n, int(r.s))
