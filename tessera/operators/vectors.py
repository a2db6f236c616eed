"""Nearest neighbours by an inverted-file index: seeded centroids, posting lists of all rows, exact re-ranking of what the probed lists hold.

Centroids are fitted on a bounded sample by digest of the id; every row is indexed. Posting lists are cut into blocks, and the
queries of a list into chunks, so that a task holds ``BLOCK`` vectors and ``CHUNK`` queries at most, also where a third of all
vectors falls into one list. A block meets a chunk as one matrix product, which keeps the best of each query: pairs are never rows.

Similarity is the cosine, in doubles. Rows without id or vector, with a null, infinite or missing component, of another dimension than the
sample's most frequent, or of length 0 are in no list and have no neighbours. Repeated ids each count as a row; a query never finds rows of its own id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import written

#: Rows of the sample that centroids and the number of probes come from, and the most lists.
SAMPLE, MOST_LISTS = 20_000, 4096
#: Vectors of a block and queries of a chunk.
BLOCK, CHUNK = 4096, 1024
ROUNDS = 8

_ROW = pa.schema([("id", pa.int64()), ("vector", pa.list_(pa.float32())), ("list", pa.int32()), ("near", pa.float64())])
_PROBE = pa.schema([("query", pa.int64()), ("vector", pa.list_(pa.float32())), ("list", pa.int32())])
_FOUND = pa.schema([("query", pa.int64()), ("id", pa.int64()), ("similarity", pa.float64())])


@dataclass
class Index:
    """``rows``: id, vector, list, block; ``centroids`` and, a list each, ``near``: the least cosine of a member to its centroid, and ``blocks``; ``probes``: lists that a query reads."""

    rows: DataFrame
    centroids: np.ndarray
    near: np.ndarray
    blocks: np.ndarray
    probes: int


def _matrix(column: pa.Array, dim: int | None = None) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1 if dim is None else dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def vectors_of(rows: DataFrame, id: str, vector: str) -> DataFrame:
    """``id, vector`` of the rows that have both, all components finite and not all 0."""
    v = F.col(vector).cast("array<float>")
    whole = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.select(F.col(id).cast("long").alias("id"), v.alias("vector")).filter(F.col("id").isNotNull() & F.coalesce(whole, F.lit(False)))


def _fit(sample: np.ndarray, lists: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    at = sample[rng.choice(len(sample), lists, replace=False)]
    for _ in range(ROUNDS):
        own = (sample @ at.T).argmax(axis=1)
        sums = np.zeros_like(at)
        np.add.at(sums, own, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        at = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), at)
    return at


def _probes(sample: np.ndarray, centroids: np.ndarray, k: int, target: float) -> int:
    """The fewest lists that hold ``target`` of the sample's own neighbours. A sample is thinner than all rows, its neighbours farther, so that on all rows no more are needed."""
    queries = sample[: min(400, len(sample))]
    scores = queries @ sample.T
    np.fill_diagonal(scores, -2)
    best = np.argsort(-scores, axis=1)[:, : min(k, len(sample) - 1)]
    own = (sample @ centroids.T).argmax(axis=1)
    order = np.argsort(np.argsort(-(queries @ centroids.T), axis=1), axis=1)
    needed = np.sort(np.take_along_axis(order, own[best], axis=1).ravel()) + 1
    return int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)]) if len(needed) else 1


def build(rows: DataFrame, id: str, vector: str, lists: int | None = None, sample: int = SAMPLE, k: int = 10, target: float = 0.95, seed: int = 7) -> Index:
    """Index all rows; ``lists`` is, where not given, the root of their number, ``MOST_LISTS`` at most; probes are set so that ``target`` of the ``k`` nearest are found."""
    found = vectors_of(rows, id, vector)
    drawn = found.withColumn("h", F.xxhash64(F.lit(seed), "id")).orderBy("h", "id").limit(sample).select("vector").toArrow().column(0).to_pylist()
    if not drawn:
        none = found.select("id", "vector", F.lit(0).alias("list"), F.lit(0).alias("block"))
        return Index(none, np.zeros((1, 1)), np.ones(1), np.zeros(1, int), 1)
    dims = [len(v) for v in drawn]
    dim = max(set(dims), key=lambda d: (dims.count(d), d))
    points = _unit(np.array([v for v in drawn if len(v) == dim]))
    n = found.count()
    centroids = _fit(points, min(lists or int(np.sqrt(n)) or 1, MOST_LISTS, len(points)), seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cosine = _unit(_matrix(batch.column(1), dim)) @ centroids.T
                own = cosine.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own.astype(np.int32)), pa.array(cosine[np.arange(len(own)), own])], schema=_ROW)

    placed = written(found.filter(F.size("vector") == dim).mapInArrow(run, "id long, vector array<float>, list int, near double"))
    # a row a list, of which there are MOST_LISTS at most
    sizes = placed.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.min("near").alias("near"))
    near, blocks = np.ones(len(centroids)), np.zeros(len(centroids), int)
    for r in sizes.collect():
        near[r["list"]], blocks[r["list"]] = r["near"], r["blocks"]
    dealt = placed.join(F.broadcast(sizes.select("list", "blocks")), "list").select("id", "vector", "list", F.pmod(F.xxhash64("id", F.lit(seed)), F.col("blocks")).cast("int").alias("block"))
    return Index(dealt, centroids, near, blocks, _probes(points, centroids, k, target))


def _to_lists(index: Index, queries: DataFrame, probes: int) -> DataFrame:
    """Each query once for each of its ``probes`` nearest lists; where it has ``bound``, for each list beyond them that may hold something as near."""
    centroids, near = index.centroids, index.near
    wide = np.arccos(np.clip(near, -1, 1))
    beyond = "bound" in queries.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cosine = _unit(_matrix(batch.column(1), centroids.shape[1])) @ centroids.T
                rank = np.argsort(np.argsort(-cosine, axis=1, kind="stable"), axis=1)
                if beyond:
                    least = np.maximum(np.arccos(np.clip(cosine, -1, 1)) - wide[None, :], 0)
                    row, to = np.nonzero((rank >= probes) & (np.cos(least) >= batch.column(2).to_numpy()[:, None] - 1e-6))
                else:
                    row, to = np.nonzero(rank < probes)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(to.astype(np.int32))], schema=_PROBE)

    return queries.mapInArrow(run, "query long, vector array<float>, list int")


def _best(k: int):
    def run(postings: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(postings) or not len(queries):
            return _FOUND.empty_table()
        ids, names = postings.column("id").to_numpy(), queries.column("query").to_numpy()
        score = _unit(_matrix(queries.column("vector").combine_chunks())) @ _unit(_matrix(postings.column("vector").combine_chunks())).T
        score[names[:, None] == ids[None, :]] = -2
        most = min(k, len(ids))
        if most < len(ids):
            kept = np.argpartition(-score, most - 1, axis=1)[:, :most]
            least = np.take_along_axis(score, kept, axis=1).min(axis=1)
            row, at = np.nonzero(score >= least[:, None])  # ties of the last one stay, for the order by id
        else:
            row, at = np.nonzero(score > -2)
        good = score[row, at] > -2
        row, at = row[good], at[good]
        return pa.Table.from_arrays([pa.array(names[row]), pa.array(ids[at]), pa.array(score[row, at])], schema=_FOUND)

    return run


def _score(index: Index, asked: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query in each block of the lists that it asks, ties of the last included."""
    asked = written(asked)
    # a row a list again
    chunks = asked.groupBy("list").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    chunked = asked.join(F.broadcast(chunks), "list").select("query", "vector", "list", F.pmod(F.xxhash64("query"), F.col("chunks")).cast("int").alias("chunk"))
    blocks = asked.sparkSession.createDataFrame([(i, int(b)) for i, b in enumerate(index.blocks)], "list int, blocks int")
    left = index.rows.join(F.broadcast(chunks), "list").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    right = chunked.join(F.broadcast(blocks.filter("blocks > 0")), "list").select("query", "vector", F.col("list").alias("of"), F.col("chunk").alias("part"), each.alias("at"))
    return left.groupBy("list", "block", "chunk").cogroup(right.groupBy("of", "at", "part")).applyInArrow(_best(k), "query long, id long, similarity double")


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(index: Index, queries: DataFrame, id: str, vector: str, k: int = 10, probes: int | None = None, exact: bool = False) -> DataFrame:
    """``query, rank, id, similarity`` of the ``k`` nearest rows of each query.

    With ``exact``, a second pass reads the lists whose members may come as near as the ``k``-th found, by the angle to the
    centroid and the list's width: the result is that of all rows. How many lists this spares depends on how clustered the vectors are.
    """
    asked = vectors_of(queries, id, vector).withColumnRenamed("id", "query").filter(F.size("vector") == index.centroids.shape[1])
    p = probes or index.probes
    found = _first(_score(index, _to_lists(index, asked, p), k), k)
    if exact:
        found = written(found)
        bound = found.groupBy("query").agg(F.when(F.count("*") >= k, F.min("similarity")).otherwise(F.lit(-1.0)).alias("bound"))
        open_ = asked.join(bound, "query", "left").select("query", "vector", F.coalesce("bound", F.lit(-1.0)).alias("bound"))
        more = _score(index, _to_lists(index, open_, p), k)
        found = _first(found.select("query", "id", "similarity").unionByName(more), k)
    return found.select("query", "rank", "id", "similarity")


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """``query, hits, wanted``: how many of a query's true neighbours were found."""
    hit = found.select("query", "id", F.lit(1).alias("hit"))
    return truth.join(hit, ["query", "id"], "left").groupBy("query").agg(F.count("hit").alias("hits"), F.count("*").alias("wanted"))
