"""Order over all rows without one task for a group: a range sort deals runs of it out, and what a run needs from the runs before it comes from one small row a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut


def spread(df: DataFrame, *keys: str | Column) -> DataFrame:
    """``df`` range-partitioned and sorted by ``keys`` (nulls first): partitions follow each other in that order.

    Bounds are sampled, so ``df`` is read twice; equal keys stay together, so give keys that tell the rows of a hot group apart.
    """
    by = [(F.col(k) if isinstance(k, str) else k).asc_nulls_first() for k in keys]
    return df.repartitionByRange(*by).sortWithinPartitions(*by)


def ranked(df: DataFrame, group: str, keys: list[str], rank: str, size: str) -> DataFrame:
    """``df``, written once, with each row's place (from 0) among its group's rows by ``keys``, and the group's size.

    Rows with equal keys get different places; null is a group. A group of any size is dealt over tasks: a row's place is
    its place in its run plus the group's rows in earlier runs, which are counted from one row for each run and group.
    """
    rows = df.withColumn("_tie", F.monotonically_increasing_id())
    # the id's upper bits name the run, the lower ones count its rows in order
    at = cut(spread(rows, group, *keys, "_tie").drop("_tie").withColumn("_at", F.monotonically_increasing_id()))
    at = at.withColumn("_run", F.shiftright("_at", 33))
    runs = at.groupBy(F.col(group).alias("_g"), F.col("_run").alias("_r")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    mine = Window.partitionBy("_g")
    runs = runs.withColumn("_before", F.sum("_n").over(mine.orderBy("_r").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")).withColumn(size, F.sum("_n").over(mine))
    joined = at.join(runs, (F.col("_run") == F.col("_r")) & F.col(group).eqNullSafe(F.col("_g")))
    return joined.withColumn(rank, F.col("_before") + F.col("_at") - F.col("_first")).drop("_at", "_run", "_g", "_r", "_n", "_first", "_before")
