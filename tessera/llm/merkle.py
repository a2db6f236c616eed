"""A Merkle manifest of a dataset: documents are leaves, sources are subtrees, and each document has its proof.

Leaves of a source stand in order of id. Blocks of ``ARITY ** DEPTH`` consecutive nodes become ordered arrays, and higher-order
functions collapse an array level by level to its root; the block roots are the nodes of the next round, until each
tree has one. So no array is longer than a block, whatever the size of a source. Going down again, a block's way to the
root is joined to its nodes. Sources' roots form the last tree in the same manner. All of it is Spark's own functions.

Defined results: null values are leaves' ``-``; rows of one id stand in order of their leaves, equal rows in any
order; a null id stands first, is never tampered with; null sources form one source, which stands first. An empty table has
no rows. Columns beyond the five are neither read nor hashed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .ordered import ranked

ARITY, DEPTH = 3, 6
BLOCK = ARITY**DEPTH
#: The fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def hashed(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def _field(value: Column) -> Column:
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(**changed: Column) -> Column:
    """The digest of a row's fields; ``changed`` puts other columns in place of some."""
    return hashed(*(_field(changed.get(f, F.col(f))) for f in FIELDS))


def _runs(nodes: Column) -> Column:
    """The next level: a digest of every ``ARITY`` consecutive nodes."""
    n = F.ceil(F.size(nodes) / F.lit(ARITY)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.sha2(F.array_join(F.slice(nodes, i * ARITY + 1, ARITY), ""), 256))


def _collapse(nodes: Column, height: Column) -> Column:
    """All levels of a block, from its nodes to its root."""
    # a block of one node alone has height 0, and a sequence from 1 to 0 would count down
    steps = F.filter(F.sequence(F.lit(1), F.lit(DEPTH)), lambda i: i <= height)
    return F.aggregate(steps, F.array(nodes), lambda levels, _: F.concat(levels, F.array(_runs(F.element_at(levels, -1)))))


def _way(levels: Column, at: Column) -> Column:
    """For the node at place ``at`` (from 0) of a block: on each level below the root, what stands left and right of it in its run."""

    def step(level: Column, k: Column) -> Column:
        own = F.floor(at / F.pow(F.lit(float(ARITY)), k)).cast("int")
        first = own - own % ARITY
        side = lambda a, n: F.array_join(F.slice(level, a + 1, n), "")
        return F.struct(side(first, own - first).alias("left"), side(own + 1, F.lit(ARITY - 1) - (own - first)).alias("right"))

    return F.transform(F.slice(levels, 1, F.size(levels) - 1), step)


def _blocks(nodes: DataFrame) -> DataFrame:
    """``g, block, n``, the members in order and all levels, from nodes (g, rank, n, node, ...)."""
    size = F.when(F.col("n") > BLOCK, F.lit(DEPTH)).otherwise(F.size(F.filter(F.array(*(F.lit(ARITY**k) for k in range(DEPTH))), lambda x: x < F.col("n"))))
    rest = [c for c in nodes.columns if c not in ("g", "n")]
    by = nodes.groupBy("g", F.floor(F.col("rank") / BLOCK).alias("block"), "n").agg(F.array_sort(F.collect_list(F.struct("rank", *(c for c in rest if c != "rank")))).alias("members"))
    return by.withColumn("levels", _collapse(F.col("members.node"), size))


def trees(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Roots (g, root) of the trees over nodes (g, rank, n, node, ...), and the nodes with ``way``, their siblings from the bottom up."""
    largest = nodes.agg(F.max("n")).first()[0] or 0
    rounds, now = [nodes], largest
    while now > 1 or len(rounds) == 1:
        up = _blocks(rounds[-1]).select("g", F.col("block").alias("rank"), F.ceil(F.col("n") / BLOCK).alias("n"), F.element_at(F.element_at("levels", -1), 1).alias("node"))
        rounds.append(cut(up))
        now = -(-now // BLOCK)
    roots = rounds[-1].select("g", F.col("node").alias("root"))
    above = rounds[-1].select("g", "rank", F.expr("cast(array() as array<struct<left:string,right:string>>)").alias("way"))
    for level in reversed(rounds[:-1]):
        up = above.select(F.col("g").alias("_g"), F.col("rank").alias("_block"), F.col("way").alias("_above"))
        met = _blocks(level).join(up, F.col("g").eqNullSafe(F.col("_g")) & (F.col("block") == F.col("_block")))
        one = met.select("g", "n", "levels", "_above", F.explode("members").alias("m"))
        above = one.select("g", "n", "m.*", F.concat(_way(F.col("levels"), (F.col("m.rank") % BLOCK).cast("int")), "_above").alias("way"))
    return roots, above


def fold(node: Column, way: Column) -> Column:
    """The root that ``node`` and its siblings lead to."""
    return F.aggregate(way, node, lambda below, s: F.sha2(F.concat(s.left, below, s.right), 256))


def manifest(docs: DataFrame, tampered: Column) -> DataFrame:
    """A row per document: its leaf, its source's root, the dataset's, its proof's digest, and whether the row with the text ``tampered`` still leads to the root.

    ``tampered`` is null where the text stays as it is.
    """
    used = docs.select(*FIELDS, F.when(tampered.isNotNull(), leaf(text=tampered)).alias("changed"))
    leaves = cut(used.select("doc_id", F.col("source").alias("g"), leaf().alias("node"), "changed"))
    placed = ranked(leaves, "g", ["doc_id", "node"], "rank", "n").select("g", "rank", "n", "node", "doc_id", "changed")
    subroots, ways = trees(placed)
    sources = ranked(subroots.select("g", F.col("root").alias("node"), F.lit(0).alias("all")), "all", ["g"], "rank", "n")
    tops, upper = trees(sources.select(F.lit(0).alias("g"), "rank", "n", "node", F.col("g").alias("source")))
    upper = upper.select("source", F.col("node").alias("subroot"), F.col("way").alias("_top")).crossJoin(tops.select("root"))  # one root
    both = ways.join(upper, F.col("g").eqNullSafe(F.col("source"))).withColumn("way", F.concat("way", "_top"))
    proof = F.sha2(F.array_join(F.transform("way", lambda s: F.concat(s.left, s.right)), ""), 256)
    out = both.select("doc_id", F.col("node").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), fold(F.coalesce("changed", "node"), F.col("way")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def lost_breaks() -> Column:
    """The tampering of the query: every second document, by crc32 of its id, loses its line breaks."""
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit("")))
