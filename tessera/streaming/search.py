"""A paged search of a literature service as a streaming source: it goes on at its cursor after a stop, and keeps to a rate.

The service is the caller's: ``count(query)`` says how many results there are now, ``page(query, start, size)`` gives the results
from ``start`` on, each a tuple of strings or numbers. Results only grow at their end, as those of a search sorted by date of entry do.

A batch takes the pages between two cursors. The cursor is the stream's offset, so Spark's checkpoint holds it: a batch that was
stopped is asked for again with the same cursors, and one that was committed never is. The driver asks for the count alone, once a
batch; pages are read by tasks, each with the retries of ``services.with_retry``. ``requests`` bounds a batch, ``per_second`` spaces its requests by start times
that the driver deals out, over batches too. A page that comes with another number of results than its cursors say raises, as results would be lost or doubled.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from ..sources.services import with_retry

Response = tuple[int, object]


class Page(InputPartition):
    def __init__(self, start: int, end: int, at: float):
        super().__init__(None)
        self.start, self.end, self.at = start, end, at


class _Cursor(DataSourceStreamReader):
    def __init__(self, query: str, count: Callable[[str], Response], page: Callable[[str, int, int], Response], size: int, requests: int, per_second: float):
        if size < 1 or requests < 1 or per_second <= 0:
            raise ValueError("size, requests and per_second are above 0")
        self.query, self.count, self.page = query, count, page
        self.size, self.requests, self.gap = size, requests, 1 / per_second
        self.cursor, self.free = 0, 0.0

    def initialOffset(self) -> dict:
        return {"cursor": 0}

    def latestOffset(self) -> dict:
        # after a restart Spark asks for the last batch's partitions first, which sets the cursor
        there = int(with_retry(lambda: self.count(self.query)))
        return {"cursor": max(self.cursor, min(there, self.cursor + self.size * self.requests))}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        self.cursor = max(self.cursor, end["cursor"])
        first = max(time.time(), self.free)
        starts = range(start["cursor"], end["cursor"], self.size)
        self.free = first + len(starts) * self.gap
        return [Page(s, min(s + self.size, end["cursor"]), first + i * self.gap) for i, s in enumerate(starts)]

    def read(self, partition: Page) -> Iterator[tuple]:
        time.sleep(max(0.0, partition.at - time.time()))
        wanted = partition.end - partition.start
        rows = with_retry(lambda: self.page(self.query, partition.start, wanted))
        if len(rows) != wanted:
            raise ValueError(f"the service gave {len(rows)} results from {partition.start} on, not {wanted}")
        for i, row in enumerate(rows):
            yield (self.query, partition.start + i, *row)

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


def search_source(name: str, count: Callable[[str], Response], page: Callable[[str, int, int], Response], fields: str) -> type[DataSource]:
    """A source class of a service, to be registered with a session: rows ``query, position`` and the ``fields`` of a result.

    Options: ``query``, ``page`` (results of a request, 100), ``requests`` (of a batch, 10) and ``per_second`` (3, what such services let anyone do).
    """

    class Search(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return f"query string, position long, {fields}"

        def streamReader(self, schema) -> DataSourceStreamReader:
            o = self.options
            return _Cursor(o.get("query", ""), count, page, int(o.get("page", 100)), int(o.get("requests", 10)), float(o.get("per_second", 3)))

    return Search


def search(spark: SparkSession, source: type[DataSource], query: str, **options: object) -> DataFrame:
    """The results of ``query`` as a stream."""
    spark.dataSource.register(source)
    return spark.readStream.format(source.name()).option("query", query).options(**{k: str(v) for k, v in options.items()}).load()


def keep(results: DataFrame, table: str, checkpoint: str, seconds: float | None = None) -> StreamingQuery:
    """Appends results to ``table``, each once whatever stops in between: the file sink's log and the checkpoint count batches.

    Goes on until it is stopped, ``seconds`` between batches (as soon as the last is done where None).
    """
    return results.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append").trigger(processingTime=f"{seconds or 0} seconds").start()
