"""A running kill switch: spending by user, event after event, in keyed state; what comes after the bound is passed isn't let through.

State is one sum a user, in the checkpoint. Events of a user count in order of id; a user's events arrive in that order
from batch to batch, and in any order within one. An event that comes again, or late with an id that was counted past, doesn't count twice: ids
not above the last counted one are left out, null ones too. Events without a user are those of one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Cents that a user may spend, by the query's rule; the bound itself is still let through.
LIMIT = 12_500

SCHEMA = "user_id long, event_id long, spent long, aborted boolean"


def cents_of(events: DataFrame) -> DataFrame:
    """``user_id, event_id, cents`` of events with a value in units; null counts 0."""
    return events.select("user_id", "event_id", F.round(F.coalesce("value", F.lit(0.0)) * 100).cast("long").alias("cents"))


def _running(limit: int, stops: bool):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        spent, last = state.get if state.exists else (0, -(1 << 62))
        # the frames of a key are those of one batch, which the source bounds
        rows = pd.concat(list(frames)).sort_values("event_id", kind="stable")
        rows = rows[rows["event_id"] > last].drop_duplicates("event_id")
        if len(rows):
            total = rows["cents"].cumsum() + spent
            user = pd.array([key[0]] * len(rows), dtype="Int64")
            out = pd.DataFrame({"user_id": user, "event_id": rows["event_id"], "spent": total, "aborted": total > limit})
            state.update((int(total.iloc[-1]), int(rows["event_id"].iloc[-1])))
            yield out[~out["aborted"]] if stops else out

    return run


def running_cost(charges: DataFrame, limit: int = LIMIT, stops: bool = False) -> DataFrame:
    """``user_id, event_id, spent, aborted`` of a stream of charges (user_id, event_id, cents); with ``stops``, only those that are let through."""
    keyed = charges.groupBy("user_id")
    return keyed.applyInPandasWithState(_running(limit, stops), SCHEMA, "spent long, last long", "append", GroupStateTimeout.NoTimeout)


def run_slices(charges: DataFrame, slices: int, folder: str, limit: int = LIMIT, stops: bool = False) -> DataFrame:
    """What ``running_cost`` gives for a table of charges that comes in ``slices`` ranges of event ids, the stream started anew for each on one checkpoint."""
    spark = charges.sparkSession
    at = [float("-inf"), *charges.approxQuantile("event_id", [i / slices for i in range(1, slices)], 0.01), float("inf")]
    come, out, checkpoint = f"{folder}/come", f"{folder}/out", f"{folder}/checkpoint"
    for low, high in zip(at, at[1:], strict=False):
        charges.filter((F.col("event_id") > low) & (F.col("event_id") <= high)).write.mode("append").parquet(come)
        stream = spark.readStream.schema(charges.schema).parquet(come)
        running_cost(stream, limit, stops).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(SCHEMA).parquet(out)
