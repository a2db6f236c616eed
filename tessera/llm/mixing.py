"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A word, for sizes.
WORD = r"[^\x20\x09-\x0D]+"
#: Hex digits of a row's draw that name its bucket: a source's draws are summed in so many buckets before one is looked into.
BUCKET_DIGITS = 3


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw_of(doc_id: Column, text: Column, seed: str = "mix") -> Column:
    """A row's seeded draw, 32 hex digits, from its id and text alone: repeated rows draw alike, reruns agree."""
    return F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")), F.md5(F.coalesce(text, F.lit("")))))


def sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix") -> DataFrame:
    """``doc_id, source, size, draw`` of every row; a null text has size 0."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size_of(F.col(text)).alias("size"), draw_of(F.col(doc_id), F.col(text), seed).alias("draw"))


def targets(sized: DataFrame, max_epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``source, source_size, weight, target`` by water-filling in closed form.

    Sources in code-point order, null last, take the weights in turn. With level L, a source gets
    min(max_epochs * size, L * weight); L is where all targets add up to the size of the corpus.
    Sorted by cap over weight, the clamped sources are a prefix: those whose cap is below the level
    that the rest would have. One row per source is all that meets in one task.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"))
    ranked = by_source.withColumn("weight", pick.cast("long")).withColumn("cap", F.col("source_size") * max_epochs)
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy()
    up_to = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    level = (
        ranked.withColumn("total", F.sum("source_size").over(all_rows))
        .withColumn("total_weight", F.sum("weight").over(all_rows))
        .withColumn("caps_before", F.sum("cap").over(up_to) - F.col("cap"))
        .withColumn("weight_from", F.col("total_weight") - F.sum("weight").over(up_to) + F.col("weight"))
        # clamped: the cap is below what this source would get were it and all after it unclamped
        .withColumn("clamped", F.col("cap") * F.col("weight_from") < (F.col("total") - F.col("caps_before")) * F.col("weight"))
        .withColumn("rest", F.col("total") - F.sum(F.when(F.col("clamped"), F.col("cap")).otherwise(0)).over(all_rows))
        .withColumn("rest_weight", F.sum(F.when(~F.col("clamped"), F.col("weight")).otherwise(0)).over(all_rows))
    )
    target = F.when(F.col("clamped"), F.col("cap").cast("double")).otherwise((F.col("rest") * F.col("weight")).cast("double") / F.col("rest_weight").cast("double"))
    return level.select("source", "source_size", "weight", target.alias("target"))


def cuts(sized: DataFrame, target: DataFrame) -> DataFrame:
    """``source, source_size, target, whole, cut, cut_words``: how a source's rate is split into repetitions.

    Every row of the source is repeated ``whole`` times. The words still missing come from its rows in the order of their
    draws: rows with a draw below ``cut`` are repeated once more, and one at the cut gives an excerpt of ``cut_words`` words.
    Sums by bucket find the bucket of the cut, so only that bucket's rows of a source are ever put in order. Repeated rows at
    the cut share its words evenly. Sources of no words have whole 0; where nothing is missing the cut is null.
    """
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(F.lit(0.0))
    t = target.withColumn("whole", F.floor(rate).cast("long")).withColumn("missing", F.col("target") - F.col("whole").cast("double") * F.col("source_size").cast("double"))
    t = t.select(F.col("source").alias("t_source"), "source_size", "target", "whole", "missing")
    upto = lambda by: Window.partitionBy("source").orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    crossed = (F.col("missing") >= F.col("before").cast("double")) & (F.col("missing") < F.col("upto").cast("double"))
    dealt = sized.withColumn("bucket", F.substring("draw", 1, BUCKET_DIGITS))
    by_bucket = dealt.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    by_bucket = by_bucket.withColumn("upto", F.sum("words").over(upto("bucket"))).withColumn("before", F.col("upto") - F.col("words"))
    of_bucket = by_bucket.join(t, by_bucket["source"].eqNullSafe(t["t_source"])).filter(crossed).select(F.col("source").alias("b_source"), F.col("bucket").alias("b_bucket"), F.col("before").alias("bucket_before"), "missing")
    rows = dealt.join(of_bucket, dealt["source"].eqNullSafe(of_bucket["b_source"]) & (dealt["bucket"] == of_bucket["b_bucket"]))
    by_draw = rows.groupBy("source", "draw").agg(F.sum("size").alias("words"), F.count("*").alias("rows"), F.first("bucket_before").alias("bucket_before"), F.first("missing").alias("missing"))
    by_draw = by_draw.withColumn("upto", F.sum("words").over(upto("draw")) + F.col("bucket_before")).withColumn("before", F.col("upto") - F.col("words"))
    cut = by_draw.filter(crossed).select(F.col("source").alias("c_source"), F.col("draw").alias("cut"), F.floor((F.col("missing") - F.col("before").cast("double")) / F.col("rows").cast("double")).cast("long").alias("cut_words"))
    return t.join(cut, t["t_source"].eqNullSafe(cut["c_source"]), "left").select(F.col("t_source").alias("source"), "source_size", "target", "whole", "cut", "cut_words")


def _taken(size: Column, draw: Column) -> tuple[Column, Column, Column]:
    """Whole repetitions, words of the excerpt and its first word, beside the columns of :func:`cuts`."""
    whole = F.col("whole") + F.when(draw < F.col("cut"), 1).otherwise(0)
    part = F.when(draw == F.col("cut"), F.col("cut_words")).otherwise(F.lit(0).cast("long"))
    u = F.conv(F.substring(draw, 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    return whole.cast("long"), part, F.floor(u * (size - part + 1).cast("double")).cast("long")


def draws(sized: DataFrame, cut: DataFrame) -> DataFrame:
    """Every row of :func:`sizes` with its source's size and target, ``taken`` words, ``whole`` repetitions and an excerpt of
    ``part`` words from word ``part_from``. No row is taken more than its rate rounded up, so never above the cap."""
    c = cut.withColumnRenamed("source", "c_source")
    joined = sized.join(c, sized["source"].eqNullSafe(c["c_source"]), "left")
    whole, part, start = _taken(F.col("size"), F.col("draw"))
    return joined.select("doc_id", "size", "source_size", "target", (whole * F.col("size") + part).alias("taken"), whole.alias("whole"), part.alias("part"), start.alias("part_from"))


def mix_texts(docs: DataFrame, cut: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix", chars: str = "n_chars") -> DataFrame:
    """The mix itself: a row for each whole repetition and one for an excerpt, all columns of ``docs`` and a count of repetitions from 0.

    The count's column is ``repetition``, with underscores behind where ``docs`` has such a column, in whatever case. An excerpt is the piece of
    the text from its first word to its last, white space included; where there is a column ``chars`` it follows the
    excerpt. Rows are drawn one by one, by id and text, so rows of one id and other texts keep their own; rows from which
    nothing is taken go.
    """
    names = {c: f"_{i}" for i, c in enumerate(docs.columns)}
    count, held = "repetition", {c.lower() for c in names}
    while count in held:
        count += "_"
    t = F.col(names[text])
    mine = docs.select(*[F.col(c).alias(v) for c, v in names.items()]).withColumn("size", size_of(t)).withColumn("draw", draw_of(F.col(names[doc_id]), t, seed))
    c = cut.select(F.col("source").alias("c_source"), "whole", "cut", "cut_words")
    whole, part, start = _taken(F.col("size"), F.col("draw"))
    drawn = mine.join(c, F.col(names[source]).eqNullSafe(F.col("c_source"))).select(*names.values(), whole.alias("whole"), part.alias("part"), start.alias("start"))
    times = F.col("whole") + F.when(F.col("part") > 0, 1).otherwise(0)
    rows = drawn.filter(times > 0).withColumn("times", F.explode(F.sequence(F.lit(0).cast("long"), times - 1)))
    words, gaps = F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), F.split(t, WORD, -1)
    start, part = F.col("start").cast("int"), F.col("part").cast("int")
    inner = F.zip_with(F.slice(words, start + 1, part - 1), F.slice(gaps, start + 2, part - 1), lambda w, g: F.concat(w, g))
    excerpt = F.concat(F.array_join(inner, ""), F.element_at(words, start + part))
    cut_here = F.col("times") >= F.col("whole")
    changed = {text: F.when(cut_here, excerpt).otherwise(t)}
    if chars in names:
        kind = docs.schema[chars].dataType
        changed[chars] = F.when(cut_here, F.length(excerpt).cast(kind)).otherwise(F.col(names[chars]))
    return rows.select(*[changed.get(k, F.col(v)).alias(k) for k, v in names.items()], F.col("times").alias(count))
