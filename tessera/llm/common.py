"""What the operators share: Arrow mapping, tables cut from their lineage, ASCII word rules."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows of one Arrow batch: a bound on what a Python worker holds at once, for texts of any usual length.
BATCH_ROWS = 500

#: Lower-cases A-Z, and nothing else.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Lower-cases A-Z and turns every ASCII character that is no letter or digit into a blank.
WORDS = bytes(32 if b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else (b + 32 if 65 <= b <= 90 else b) for b in range(256))


def encode(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def word_list(text: str | None) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` as UTF-8."""
    return encode(text).translate(WORDS).split()


def _read(column: pa.Array) -> list:
    """Values; lists of numbers come as numpy arrays."""
    if pa.types.is_list(column.type) and pa.types.is_integer(column.type.value_type) and not column.null_count:
        ends, flat = column.offsets.to_numpy(), column.values.to_numpy()
        return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return column.to_pylist()


def _write(values: list, kind: pa.DataType) -> pa.Array:
    if pa.types.is_list(kind) and values and isinstance(values[0], np.ndarray):
        ends = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values), type=kind.value_type), type=kind)
    return pa.array(values, type=kind)


def map_columns(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: str | T.StructType) -> DataFrame:
    """Apply ``fn`` from columns to columns through Arrow, at most ``BATCH_ROWS`` rows at once.

    ``fn`` may return more or fewer rows than it gets. Spark bounds the batches it sends by
    ``spark.sql.execution.arrow.maxRecordsPerBatch`` and ``maxBytesPerBatch``; what is made of one is bounded here.
    """
    out = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                got = fn({name: _read(part.column(i)) for i, name in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([_write(got[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, out)


def filter_texts(df: DataFrame, keep: Callable[[list], list[bool]], text: str = "text") -> DataFrame:
    """Rows of ``df``, with all their columns, for whose text ``keep`` says True."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(i, BATCH_ROWS)
                yield part.filter(pa.array(keep(part.column(at).to_pylist()), type=pa.bool_()))

    return df.mapInArrow(run, df.schema)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares. Only a session of one machine, as in tests, gets a temporary one where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def labelled_sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, rows: int, text_bytes: int, all_bytes: int) -> list[tuple[str | None, int]]:
    """Texts and labels of a bounded sample by hash, in a fixed order: at most ``rows`` rows of texts up to ``text_bytes``, and of those
    the first that together have ``all_bytes``. Null ids and labels are left out. A repeated id is drawn with all its rows, within the bounds."""
    y = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).filter("id is not null and y is not null").distinct()
    # the ids are drawn first, so that only drawn documents carry their texts through the join
    drawn = y.withColumn("h", F.xxhash64("id")).orderBy("h", "id", "y").limit(rows)
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    d = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).withColumn("size", size).filter(F.col("size") <= text_bytes)
    order = ("h", "id", "y", F.md5(F.coalesce("text", F.lit(""))))
    few = d.join(F.broadcast(drawn), "id").orderBy(*order).limit(rows)
    upto = F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    got = few.withColumn("upto", upto).filter(F.col("upto") <= all_bytes).orderBy("upto", *order).select("text", "y").collect()
    return [(r.text, r.y) for r in got]


class Cut:
    """A table written once to the shared folder and read back: lineage ends there, and lost executors cost nothing."""

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.path = f"{shared_folder(self.spark)}/cut-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    return Cut(df).df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
