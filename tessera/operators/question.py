"""Questions: concepts, hierarchy distance, selection and relevance order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_surface


def shared_nodes(a: Column, b: Column) -> Column:
    """Length of the common prefix of two arrays of path nodes, node by node."""
    least = F.least(F.size(a), F.size(b))
    same = F.transform(F.sequence(F.lit(0), least - 1), lambda i: F.get(a, i) == F.get(b, i))
    return F.when(least == 0, 0).otherwise(F.coalesce(F.nullif(F.array_position(same, F.lit(False)), F.lit(0)) - 1, least.cast("long")))


def distances(pairs: DataFrame, tree: DataFrame) -> DataFrame:
    """``a, b, distance`` of distinct concept pairs: the least path length over placements that share a root node, else null."""
    t = tree.select("concept_id", F.split("tree_number", r"\.").alias("path"))
    left, right = t.select(F.col("concept_id").alias("a"), F.col("path").alias("pa")), t.select(F.col("concept_id").alias("b"), F.col("path").alias("pb"))
    shared = shared_nodes(F.col("pa"), F.col("pb"))
    met = pairs.select("a", "b").distinct().join(left, "a", "left").join(right, "b", "left").withColumn("shared", shared)
    far = F.size("pa") + F.size("pb") - 2 * F.col("shared")
    return met.groupBy("a", "b").agg(F.min(F.when(F.col("shared") > 0, far)).cast("int").alias("distance"))


def question_terms(questions: DataFrame, resolved: DataFrame, pattern: str = r"\p{L}{7,}") -> DataFrame:
    """``query_id, concept_id, term``: linked words of each question, the first term of a concept as its evidence."""
    words = questions.select("query_id", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("ord", "w"))
    hit = words.withColumn("alias_key", normalize_surface(F.col("w"))).join(resolved, "alias_key")
    return hit.groupBy("query_id", "concept_id").agg(F.min_by("w", "ord").alias("term"))


def rank_clusters(clusters: DataFrame, terms: DataFrame, tree: DataFrame, actions: DataFrame) -> DataFrame:
    """``query_id, key, matched, proximity, rank``: the groups that a question selects, in order.

    A side matches as a concept of the question or as a member of a class that is one. Order: more matched sides first;
    then the greatest, over unmatched sides, of the least distance to a concept of the question, where a side
    that shares no tree makes it null, which sorts last; then the key. No unmatched side: 0. Size is no signal.
    """
    sides = clusters.select("key", F.explode(F.array("chemical_id", "disease_id")).alias("side")).distinct()
    ids = terms.select("query_id", "concept_id").distinct()
    direct = sides.join(ids, sides["side"] == ids["concept_id"]).select("query_id", "key", "side")
    by_class = sides.join(actions.withColumnRenamed("concept_id", "side"), "side").join(ids, F.col("class_id") == ids["concept_id"]).select("query_id", "key", "side")
    matched = direct.unionByName(by_class).distinct()
    count = matched.groupBy("query_id", "key").agg(F.count("*").cast("int").alias("matched"))
    chosen = count.join(sides, "key").join(matched.withColumn("is", F.lit(True)), ["query_id", "key", "side"], "left")
    open_sides = chosen.filter("is is null").select("query_id", "key", "side")
    asked = open_sides.join(ids, "query_id").select("query_id", "key", F.col("side").alias("a"), F.col("concept_id").alias("b"))
    near = asked.join(distances(asked, tree), ["a", "b"]).groupBy("query_id", "key", "a").agg(F.min("distance").alias("d"))
    worst = near.groupBy("query_id", "key").agg(F.when(F.count_if(F.col("d").isNull()) == 0, F.max("d")).cast("double").alias("proximity"), F.lit(True).alias("open"))
    out = count.join(worst, ["query_id", "key"], "left").withColumn("proximity", F.when(F.col("open").isNull(), 0.0).otherwise(F.col("proximity")))
    order = Window.partitionBy("query_id").orderBy(F.desc("matched"), F.asc_nulls_last("proximity"), "key")
    return out.select("query_id", "key", "matched", "proximity", F.row_number().over(order).alias("rank"))


def ties(ranked: DataFrame) -> DataFrame:
    """Whether a row's signals equal those of the rank before."""
    w = Window.partitionBy("query_id").orderBy("rank")
    same = F.lag("matched").over(w).eqNullSafe(F.col("matched")) & F.lag("proximity").over(w).eqNullSafe(F.col("proximity")) & (F.col("rank") > 1)
    return ranked.withColumn("tied", same)
