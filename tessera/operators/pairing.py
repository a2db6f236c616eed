"""Pairs of concepts, groups of papers, diagnostics and pair enumeration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.tables import written


def _pairs(linked: DataFrame, keys: list[str]) -> DataFrame:
    """Each chemical with each disease of equal ``keys``, once. Rows are dealt by paper once, for the distinct sides, their join and what is grouped by paper later;
    over all shuffle partitions, as they are few, but their product is not."""
    parts = int(linked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = linked.filter("canonical_id is not null").select(*keys, "label", "canonical_id").repartition(parts, "paper_id")
    side = lambda label, name: dealt.filter(F.col("label") == label).select(*keys, F.col("canonical_id").alias(name)).distinct()
    return side("CHEMICAL", "chemical_id").join(side("DISEASE", "disease_id").hint("merge"), keys)


def cross_pairs(linked: DataFrame) -> DataFrame:
    """Every linked chemical of a paper with every linked disease of it: the product of two distinct sides, so nothing is made distinct again."""
    return _pairs(linked, ["paper_id"]).select("paper_id", "chemical_id", "disease_id")


def cross_arrays(linked: DataFrame) -> DataFrame:
    """:func:`cross_pairs` as ``paper_id, chemical_id, diseases``: a row for each chemical of a paper, with an array of the paper's diseases."""
    parts = int(linked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = linked.filter("canonical_id is not null").select("paper_id", "label", "canonical_id").repartition(parts, "paper_id")
    diseases = dealt.filter(F.col("label") == "DISEASE").groupBy("paper_id").agg(F.collect_set("canonical_id").alias("diseases"))
    return dealt.filter(F.col("label") == "CHEMICAL").select("paper_id", F.col("canonical_id").alias("chemical_id")).distinct().join(diseases.hint("merge"), "paper_id")


def placed_pairs(located: DataFrame) -> DataFrame:
    """:func:`cross_pairs` with the sentences of their sides: ``paper_id, chemical_id, disease_id, chemical_in, disease_in, chemical_bits, disease_bits, n_chemical, n_disease``.

    The arrays hold the sentences in which the concept starts as a chemical or as a disease, the bits those modulo 64, the numbers count those in which it starts as either. So a pair's own
    row tells whether both start in one sentence (:func:`together`), and nothing that is asked of all pairs of a paper sends them anywhere. Concepts are dealt by paper
    over all shuffle partitions: they are few, but their product is not.
    """
    parts = int(located.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = located.filter("canonical_id is not null").select("paper_id", "label", "canonical_id", "sentence_index").repartition(parts, "paper_id")
    at = lambda label: F.collect_set(F.when(F.col("label") == label, F.col("sentence_index")))
    bits = lambda label: F.coalesce(F.bit_or(F.when(F.col("label") == label, F.expr("shiftleft(1L, cast(pmod(sentence_index, 64) as int))"))), F.lit(0).cast("long"))
    is_a = lambda label: F.bool_or(F.col("label") == label)
    each = dealt.groupBy("paper_id", "canonical_id").agg(is_a("CHEMICAL").alias("c"), is_a("DISEASE").alias("d"), at("CHEMICAL").alias("chemical_in"), at("DISEASE").alias("disease_in"), bits("CHEMICAL").alias("chemical_bits"), bits("DISEASE").alias("disease_bits"), F.count_distinct("sentence_index").alias("n"))
    side = lambda flag, name: each.filter(flag).select("paper_id", F.col("canonical_id").alias(f"{name}_id"), f"{name}_in", f"{name}_bits", F.col("n").alias(f"n_{name}"))
    return side("c", "chemical").join(side("d", "disease").hint("merge"), "paper_id").select("paper_id", "chemical_id", "disease_id", "chemical_in", "disease_in", "chemical_bits", "disease_bits", "n_chemical", "n_disease")


def together() -> Column:
    """Whether both sides of a placed pair start in one sentence. Where no bit is common no sentence is, so few arrays are looked at."""
    return F.when(F.col("chemical_bits").bitwiseAND(F.col("disease_bits")) == 0, F.lit(False)).otherwise(F.arrays_overlap("chemical_in", "disease_in"))


def outside_cross_pairs(relations: DataFrame, linked: DataFrame) -> DataFrame:
    """Relations that aren't cross pairs of ``linked``: those of whose chemical or disease their paper has no such mention.

    A paper's concepts are looked up, each once, not its pairs; only relations of concepts found missing are looked at again.
    """
    missing = []
    for label, name in (("CHEMICAL", "chemical_id"), ("DISEASE", "disease_id")):
        has = linked.filter((F.col("label") == label) & F.col("canonical_id").isNotNull()).select("paper_id", F.col("canonical_id").alias(name)).distinct()
        lost = written(relations.select("paper_id", name).distinct().join(has, ["paper_id", name], "left_anti").withColumn(f"_{name}", F.lit(True)))
        missing.append((lost, name))
    x = relations
    for lost, name in missing:
        x = x.join(lost.withColumnsRenamed({"paper_id": "_p", name: "_n"}), F.col("_p").eqNullSafe(F.col("paper_id")) & F.col("_n").eqNullSafe(F.col(name)), "left").drop("_p", "_n")
    return x.filter("_chemical_id or _disease_id").drop("_chemical_id", "_disease_id")


def same_sentence_pairs(located: DataFrame) -> DataFrame:
    """Linked chemicals and diseases that start in one sentence."""
    return _pairs(located, ["paper_id", "sentence_index"]).select("paper_id", "chemical_id", "disease_id").distinct()


def cluster_papers(pairs: DataFrame, min_size: int = 2) -> DataFrame:
    """``chemical_id, disease_id, n_papers, paper_ids`` of pairs with enough distinct papers, in no order (:func:`in_key_order`).

    Rows are dealt by key once; sizes, which drop the keys that are too small, and the papers of the others are found where they then lie. An array
    holds a key's papers; :func:`pair_table` is the form for keys of any size.
    """
    distinct = pairs.select("paper_id", "chemical_id", "disease_id").repartition("chemical_id", "disease_id").distinct()
    big = distinct.groupBy("chemical_id", "disease_id").agg(F.count("*").alias("n_papers")).filter(F.col("n_papers") >= min_size)
    held = distinct.join(big.select("chemical_id", "disease_id"), ["chemical_id", "disease_id"], "left_semi")
    return held.groupBy("chemical_id", "disease_id").agg(F.count("*").alias("n_papers"), F.sort_array(F.collect_list("paper_id")).alias("paper_ids"))


#: Papers of a key up to which they are kept as one array; those of a larger key are bitmaps.
ARRAY = 1_000
_KEY = ["chemical_id", "disease_id"]


def _bitmaps(rows: DataFrame) -> DataFrame:
    """``chemical_id, disease_id, bucket, bits`` of rows with a paper each: a bitmap for every 32,768 consecutive ids, made by partial aggregates, in which repeats vanish."""
    bucket = F.bitmap_bucket_number("paper_id").alias("bucket")
    return rows.groupBy(*_KEY, bucket).agg(F.bitmap_construct_agg(F.bitmap_bit_position("paper_id")).alias("bits"))


def cluster_members(pairs: DataFrame, min_size: int = 2, most: int = ARRAY) -> DataFrame:
    """``chemical_id, disease_id, n_papers, paper_ids, bucket, bits``: the groups of :func:`cluster_papers` at any size; ids are whole numbers, not null.

    A key of up to ``most`` papers is a row with their array; a larger one is a row for each bucket of ids, with a bitmap of 4 KB. So no
    row grows with its key, and a key's rows are spread by bucket.
    """
    distinct = pairs.select("paper_id", *_KEY).filter("paper_id is not null").repartition(*_KEY).distinct()
    sized = written(distinct.join(distinct.groupBy(*_KEY).agg(F.count("*").alias("n_papers")).filter(F.col("n_papers") >= min_size), _KEY))
    few = sized.filter(F.col("n_papers") <= most).groupBy(*_KEY, "n_papers").agg(F.sort_array(F.collect_list("paper_id")).alias("paper_ids"))
    many = sized.filter(F.col("n_papers") > most)
    bits = _bitmaps(many).join(many.select(*_KEY, "n_papers").distinct(), _KEY)
    return few.unionByName(bits, allowMissingColumns=True)


def pooled_members(runs: DataFrame, most: int = ARRAY) -> DataFrame:
    """As :func:`cluster_members`, one group a key, from the members of several runs: bitmaps are joined bit by bit, arrays as long as their union is short."""
    total = runs.groupBy(*_KEY).agg((F.max(F.col("bits").isNotNull()) | (F.sum(F.coalesce(F.size("paper_ids"), F.lit(0))) > most)).alias("_large"))
    each = written(runs.join(total, _KEY))
    short = each.filter("paper_ids is not null").select(*_KEY, "_large", F.explode("paper_ids").alias("paper_id"))
    few = short.filter("not _large").distinct().groupBy(*_KEY).agg(F.count("*").alias("n_papers"), F.sort_array(F.collect_list("paper_id")).alias("paper_ids"))
    bits = each.filter("bits is not null").select(*_KEY, "bucket", "bits").unionByName(_bitmaps(short.filter("_large")))
    bits = written(bits.groupBy(*_KEY, "bucket").agg(F.bitmap_or_agg("bits").alias("bits")))
    n = bits.groupBy(*_KEY).agg(F.sum(F.bitmap_count("bits")).alias("n_papers"))
    return few.unionByName(bits.join(n, _KEY), allowMissingColumns=True)


def members_of(groups: DataFrame) -> DataFrame:
    """``chemical_id, disease_id, paper_id``, a row a member, of groups as arrays and bitmaps."""
    out = T.StructType([*(groups.schema[k] for k in _KEY), T.StructField("paper_id", T.LongType())])
    arrow = to_arrow_schema(out)

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                # buckets from 1 on hold ids from 1 on, upwards; those from 0 on, downwards, ids from 0 on, downwards
                bits, bucket = np.unpackbits(np.frombuffer(batch.column(3)[i].as_py(), np.uint8), bitorder="little"), batch.column(2)[i].as_py()
                at = np.flatnonzero(bits)
                ids = (bucket - 1) * len(bits) + at + 1 if bucket > 0 else bucket * len(bits) - at
                own = [pa.array([batch.column(c)[i].as_py()] * len(ids), arrow.field(c).type) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(ids)], schema=arrow)

    few = groups.filter("paper_ids is not null").select(*_KEY, F.explode(F.col("paper_ids").cast("array<long>")).alias("paper_id"))
    return few.unionByName(groups.filter("bits is not null").select(*_KEY, "bucket", "bits").mapInArrow(unpacked, out))


def pooled_rows(relations: DataFrame, members: DataFrame, among: Column) -> DataFrame:
    """``chemical_id, disease_id, paper_id``: the pooled members of a run of ``relations``, in groups of any size, and of another's ``members``.

    ``among`` says of a member's own row whether it is one of the relations. So nothing is looked for among the relations, which may be many times the
    members, and none of them is dealt by key or written.
    """
    cols = [*_KEY, "paper_id"]
    return relations.select(*cols).unionByName(members.filter(~among).select(*cols))


def in_key_order(clusters: DataFrame) -> DataFrame:
    """Clusters by key in code-point order, by a range partitioning."""
    return clusters.orderBy("chemical_id", "disease_id")


def pair_table(pairs: DataFrame, min_size: int = 2) -> DataFrame:
    """``key, paper_id`` in long form: what the group of a large key is without an array."""
    keyed = pairs.select(F.concat_ws("|", "chemical_id", "disease_id").alias("key"), "paper_id").distinct()
    big = keyed.groupBy("key").agg(F.count("*").alias("n_papers")).filter(F.col("n_papers") >= min_size)
    return keyed.join(big, "key")


#: Papers of a key that are paired in one task.
PAIR_BLOCK = 1_000


def paper_pairs(long: DataFrame) -> DataFrame:
    """Distinct unordered pairs of papers that share a key, from ``key, paper_id, n_papers``.

    A key's papers are dealt into blocks of about ``PAIR_BLOCK``, and each two blocks meet in a cell of their own, so
    a key of any size is paired in many tasks, and one of a single block is joined as it is.
    """
    blocks = F.ceil(F.col("n_papers") / PAIR_BLOCK).cast("int")
    dealt = long.select("key", "paper_id", blocks.alias("_n"), F.pmod(F.xxhash64("paper_id"), blocks).cast("int").alias("_b"))
    cells = dealt.withColumn("_x", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).select("key", "paper_id", "_b", F.least("_b", "_x").alias("_i"), F.greatest("_b", "_x").alias("_j"))
    a, b = cells.alias("a"), cells.alias("b")
    cell = (F.col("a.key") == F.col("b.key")) & (F.col("a._i") == F.col("b._i")) & (F.col("a._j") == F.col("b._j"))
    own = (F.col("a._i") == F.col("a._j")) | (F.col("a._b") != F.col("b._b"))
    return a.join(b, cell & own & (F.col("a.paper_id") < F.col("b.paper_id"))).select(F.col("a.paper_id").alias("paper_id_a"), F.col("b.paper_id").alias("paper_id_b")).distinct()


def workload(sizes: DataFrame) -> DataFrame:
    """Comparisons, largest group and the share of the five largest, from ``key, n_papers``."""
    pairs = (F.col("n_papers") * (F.col("n_papers") - 1) / 2).cast("long")
    each = sizes.withColumn("pairs", pairs)
    top = each.orderBy(F.desc("n_papers"), "key").limit(5).agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("top5"))
    total = each.agg(F.count("*").alias("n_clusters"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("comparisons"), F.coalesce(F.max("n_papers"), F.lit(0)).alias("largest"))
    return total.join(top).select("n_clusters", "comparisons", "largest", F.when(F.col("comparisons") == 0, 0.0).otherwise(F.col("top5").cast("double") / F.col("comparisons").cast("double")).alias("top5_share"))


def diagnostics(papers: DataFrame, linked: DataFrame, located: DataFrame) -> DataFrame:
    """Unlinked mentions by label, papers without a linked chemical or disease, linked mentions in no sentence."""
    per = linked.groupBy("paper_id").agg(
        F.count_if((F.col("label") == "CHEMICAL") & F.col("canonical_id").isNull()).alias("nil_chemical"), F.count_if((F.col("label") == "DISEASE") & F.col("canonical_id").isNull()).alias("nil_disease"),
        F.count_if((F.col("label") == "CHEMICAL") & F.col("canonical_id").isNotNull()).alias("c"), F.count_if((F.col("label") == "DISEASE") & F.col("canonical_id").isNotNull()).alias("d"),
    )
    n_located = located.filter("canonical_id is not null").agg(F.count("*").alias("n_located"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    totals = papers.select("paper_id").join(per, "paper_id", "left").agg(
        zero(F.sum("nil_chemical")).alias("nil_chemical"), zero(F.sum("nil_disease")).alias("nil_disease"), F.count_if(zero(F.col("c")) == 0).alias("papers_without_chemical"), F.count_if(zero(F.col("d")) == 0).alias("papers_without_disease"), zero(F.sum(F.col("c") + F.col("d"))).alias("linked"),
    )
    return totals.join(n_located).select("nil_chemical", "nil_disease", "papers_without_chemical", "papers_without_disease", (F.col("linked") - F.col("n_located")).alias("unplaceable"))


def first_by(rows: DataFrame, keys: list[str], order: list, n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in a stated order; never an order-free de-duplication."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_rn") <= n).drop("_rn")
