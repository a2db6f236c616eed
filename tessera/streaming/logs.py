"""A log that batches are appended to, each once, and its compaction to the last write of each key.

A batch writes its rows to a folder of its own number, over whatever a failed try has left there, and then says so in the manifest. Readers
take what the manifest names, so half a batch is never seen; a batch that is run again after its line was written names the same folder, and counts
once. A compaction writes the last row of each key to a new folder and then names it, with the batches that it stands for; it may fail or be
repeated at any point. Old folders stay until ``clean`` takes them away, so that readers under way aren't disturbed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: A line of the manifest: a batch, or a compaction of all batches up to that one.
LINE = "batch long, folder string, compacted boolean"


def write_batch(rows: DataFrame, batch: int, path: str) -> None:
    """Adds a numbered batch to the log at ``path``; the same number again replaces it."""
    folder = f"data/batch-{batch}"
    rows.withColumn("_batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{path}/{folder}")
    _say(rows.sparkSession, path, batch, folder, False)


def _say(spark: SparkSession, path: str, batch: int, folder: str, compacted: bool) -> None:
    spark.createDataFrame([(batch, folder, compacted)], LINE).coalesce(1).write.mode("append").json(f"{path}/manifest")


def append(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what has come of a stream and ends; a restart goes on with the batch that wasn't finished."""
    return rows.writeStream.foreachBatch(lambda df, batch: write_batch(df, batch, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _current(spark: SparkSession, path: str) -> tuple[list[str], int]:
    """The folders that make up the log now, a line a batch since the last compaction, and the last batch."""
    lines = {(r.batch, r.folder, r.compacted) for r in spark.read.schema(LINE).json(f"{path}/manifest").collect()}
    done = max((x for x in lines if x[2]), default=(-1, None, True))
    later = sorted(x for x in lines if not x[2] and x[0] > done[0])
    return [f for f in (done[1], *(x[1] for x in later)) if f], max((x[0] for x in lines), default=-1)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all batches that are finished, with ``_batch``; of compacted ones, the last write of each key."""
    folders, _ = _current(spark, path)
    if not folders:
        raise ValueError(f"{path} has no finished batch")
    return spark.read.parquet(*(f"{path}/{f}" for f in folders))


def last_writes(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: of the latest batch, then by ``order``; a partial maximum, so a key of any number of rows doesn't meet in a task."""
    held = [c for c in rows.columns if c not in keys]
    last = F.max(F.struct("_batch", *(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)), F.struct(*held).alias("_row"))).alias("_last")
    return rows.groupBy(*keys).agg(last).select(*keys, "_last._row.*").select(*rows.columns)


def compact(spark: SparkSession, path: str, keys: list[str], order: list[str]) -> None:
    """Puts the last write of each key in place of all finished batches."""
    _, batch = _current(spark, path)
    folder = f"data/compact-{uuid.uuid4().hex}"
    last_writes(read(spark, path), keys, order).write.parquet(f"{path}/{folder}")
    _say(spark, path, batch, folder, True)


def clean(spark: SparkSession, path: str) -> int:
    """Takes away the folders that the log is no longer made of, and says how many; only when nobody reads or writes it."""
    kept, _ = _current(spark, path)
    jvm = spark.sparkContext._jvm
    data = jvm.org.apache.hadoop.fs.Path(f"{path}/data")
    fs = data.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = [s.getPath() for s in fs.listStatus(data) if f"data/{s.getPath().getName()}" not in kept]
    return sum(bool(fs.delete(p, True)) for p in old)


def log_slices(rows: DataFrame, slices: int, number: str, folder: str, keys: list[str]) -> DataFrame:
    """A table that comes in ranges of ``number``, logged by a stream that is started anew for each, compacted halfway; the last writes."""
    spark = rows.sparkSession
    at = [float("-inf"), *rows.approxQuantile(number, [i / slices for i in range(1, slices)], 0.01), float("inf")]
    come, path, checkpoint = f"{folder}/come", f"{folder}/log", f"{folder}/checkpoint"
    for i, (low, high) in enumerate(zip(at, at[1:], strict=False)):
        rows.filter((F.col(number) > low) & (F.col(number) <= high)).write.mode("append").parquet(come)
        append(spark.readStream.schema(rows.schema).parquet(come), path, checkpoint).awaitTermination()
        if i == slices // 2:
            compact(spark, path, keys, [number])
    return last_writes(read(spark, path), keys, [number]).drop("_batch")
