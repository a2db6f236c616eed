"""Overlaps of spans by a sweep: no span meets another's row, only counts of what began and ended before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _present(keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).isNotNull()
    return out


def overlap_counts(spans: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct ``keys, start, end`` of ``spans`` with ``n``, the rows of ``others`` of the same keys that share a character with it, and ``equal``, those with its very offsets.

    Of the others, those overlap that begin before the span's end, less those that end at its start or before: both are running
    sums along the offsets, so the work is that of sorting a group's spans, not of pairing them. Empty spans, and rows with a null key or
    offset, overlap nothing.
    """
    zero = F.lit(0).cast("long")
    o = others.filter(_present(keys) & (F.col("start") < F.col("end"))).groupBy(*keys, "start", "end").agg(F.count("*").alias("w"))
    s = spans.select(*keys, "start", "end").distinct()
    # at one offset: ends count for a start there, starts don't count for an end there
    events = o.select(*keys, "start", "end", "w", F.explode(F.array(F.struct(F.col("end").alias("at"), F.lit(0).alias("kind")), F.struct(F.col("start").alias("at"), F.lit(2).alias("kind")))).alias("x"))
    asked = s.select(*keys, "start", "end", zero.alias("w"), F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("kind")), F.struct(F.col("end").alias("at"), F.lit(1).alias("kind")))).alias("x"))
    order = Window.partitionBy(*keys).orderBy("at", "kind").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    both = events.withColumn("own", F.lit(False)).unionByName(asked.withColumn("own", F.lit(True))).select("*", "x.*").drop("x")
    upto = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("w"))).over(order), zero)
    swept = both.withColumns({"_begun": upto(2), "_ended": upto(0)})
    own = F.col("own")
    at_end, at_start = own & (F.col("at") == F.col("end")), own & (F.col("at") == F.col("start"))
    met = swept.groupBy(*keys, "start", "end").agg(
        F.coalesce(F.max(F.when(at_end, F.col("_begun"))) - F.max(F.when(at_start, F.col("_ended"))), zero).alias("n"), F.coalesce(F.max(F.when(~own, F.col("w"))), zero).alias("equal"), F.bool_or(own).alias("own")
    ).filter("own").drop("own")
    whole = _present(keys) & (F.col("start") < F.col("end"))
    return met.withColumns({"n": F.when(whole, F.col("n")).otherwise(zero), "equal": F.when(whole, F.col("equal")).otherwise(zero)})
