"""Selections of sentences and queries: baselines scored against gold, padding to a budget, screens, leads and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import ratio
from ..functions.text import seeded_uniform
from .pairing import first_by
from .spans import overlap_counts

#: The ladders of the positional baselines, in sentences and in tenths.
FIRST, TENTHS = (1, 2, 3, 4, 5, 6), (1, 2, 3, 4, 5)


def by_index(sentences: DataFrame, chosen: DataFrame) -> DataFrame:
    """Sentences of the chosen indices: each once, in order; an index out of range goes."""
    return sentences.join(chosen.select("paper_id", "sentence_index").distinct(), ["paper_id", "sentence_index"], "left_semi")


def gold_sentences(relations: DataFrame, located: DataFrame) -> DataFrame:
    """``paper_id, sentence_index, chemical_id, disease_id``: sentences in which both sides of a gold relation start."""
    side = lambda label, name: located.filter((F.col("label") == label) & F.col("canonical_id").isNotNull()).select("paper_id", "sentence_index", F.col("canonical_id").alias(name)).distinct()
    with_chemical = relations.select("paper_id", "chemical_id", "disease_id").distinct().join(side("CHEMICAL", "chemical_id"), ["paper_id", "chemical_id"])
    return with_chemical.join(side("DISEASE", "disease_id"), ["paper_id", "sentence_index", "disease_id"], "left_semi").select("paper_id", "sentence_index", "chemical_id", "disease_id")


def score_positions(sentences: DataFrame, gold: DataFrame) -> DataFrame:
    """Each positional baseline's selection and its recall of gold sentences: one pass, all selectors at once."""
    n = sentences.groupBy("paper_id").agg((F.max("sentence_index") + 1).alias("n"))
    mark = gold.select("paper_id", "sentence_index").distinct().withColumn("_gold", F.lit(True))
    flags = sentences.select("paper_id", "sentence_index").join(n, "paper_id").join(mark, ["paper_id", "sentence_index"], "left").withColumn("_gold", F.coalesce("_gold", F.lit(False)))
    i = F.col("sentence_index")
    names = [F.when(i < k, f"first_{k}") for k in FIRST] + [F.when(i < F.ceil(F.lit(f / 10) * F.col("n")), f"fraction_{f}") for f in TENTHS]
    # the row without a selector carries the totals
    each = flags.select("_gold", F.explode(F.array_append(F.array_compact(F.array(*names)), F.lit("all"))).alias("selector"))
    counts = each.groupBy("selector").agg(F.count("*").alias("n_selected"), F.count_if("_gold").alias("hits"))
    total = counts.filter("selector = 'all'").select(F.col("n_selected").alias("total"), F.col("hits").alias("gold_total"))
    x = counts.filter("selector <> 'all'").crossJoin(F.broadcast(total))
    return x.select("selector", "n_selected", "hits", "total", "gold_total", ratio(F.col("n_selected"), F.col("total")).alias("rate"), ratio(F.col("hits"), F.col("gold_total")).alias("recall"))


def strongest(scored: DataFrame, budget: float) -> DataFrame:
    """The baseline of the highest recall among those whose rate is within the budget; of a tie the first name."""
    return scored.filter(F.col("rate") <= budget).orderBy(F.desc("recall"), "selector").limit(1)


#: Digits of a draw that make a bucket when a selection is padded: at most 65,536 buckets.
PAD_DIGITS = 4


def pad_to_budget(base: DataFrame, rows: DataFrame, budget: int, seed: str, key: list[str]) -> DataFrame:
    """``base`` filled with other rows by seeded draws without replacement until it has ``budget`` rows.

    Draws are ordered by bucket: whole buckets enter up to the one in which the budget ends, and only that one is
    ranked row by row, so no task sees all rows. A budget below the base or above all rows raises.
    """
    chosen = base.select(*key).distinct()
    n_base, n_all = chosen.count(), rows.select(*key).distinct().count()
    if not n_base <= budget <= n_all:
        raise ValueError(f"a selection of {n_base} among {n_all} can't be padded to {budget}")
    draw = F.md5(F.concat_ws("|", F.lit(seed), *[F.col(k).cast("string") for k in key]))
    rest = rows.select(*key).distinct().join(chosen, key, "left_anti").withColumn("_draw", draw).withColumn("_bucket", F.substring("_draw", 1, PAD_DIGITS))
    sizes = rest.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = (F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")).alias("_before")
    # at most 16 ** PAD_DIGITS rows, whatever the input
    room = sizes.select("_bucket", before).filter(F.col("_before") < budget - n_base)
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy("_draw", *key))
    padding = rest.join(F.broadcast(room), "_bucket").withColumn("_rn", rank).filter(F.col("_before") + F.col("_rn") <= budget - n_base)
    return chosen.unionByName(padding.select(*key))


def screen(queries: DataFrame, k: int, quota: dict[str, int], floor: int = 8) -> DataFrame:
    """``query_id, stratum, n_clusters`` of at most ``k`` queries: each stratum's quota first, then by number of clusters."""
    order = [F.desc("n_clusters"), "query_id"]
    eligible = queries.filter(F.col("n_clusters") >= floor)
    want = F.lit(0)
    for name, n in quota.items():
        want = F.when(F.col("stratum") == name, n).otherwise(want)
    ranked = eligible.withColumn("_in", F.row_number().over(Window.partitionBy("stratum").orderBy(*order)) <= want)
    return ranked.orderBy(F.desc("_in"), *order).limit(max(k, sum(quota.values()))).drop("_in").orderBy(*order).limit(k)


def leads(ranked: DataFrame, labels: DataFrame) -> DataFrame:
    """The best-ranked labelled group of each query that has an answer at all."""
    known = ranked.join(labels.filter("tier is not null"), ["query_id", "key"])
    answered = known.filter("tier = 'answers'").select("query_id").distinct()
    return first_by(known.join(answered, "query_id", "left_semi"), ["query_id"], ["rank"])


#: Tiers from best to worst.
TIERS = ("answers", "background", "off_topic")


def inversions(labelled: DataFrame) -> DataFrame:
    """``query_id, pairs, inverted``: ordered pairs of different tiers, and those whose earlier member is the worse one.

    Counted from running counts by tier, not by meeting pairs.
    """
    before = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    known = labelled.filter("tier is not null")
    at = F.array_position(F.array(*[F.lit(t) for t in TIERS]), F.col("tier"))
    x = known.withColumn("_t", at)
    for i in range(1, len(TIERS) + 1):
        x = x.withColumn(f"_b{i}", F.coalesce(F.sum((F.col("_t") == i).cast("long")).over(before), F.lit(0)))
    other = sum((F.when(F.col("_t") != i, F.col(f"_b{i}")).otherwise(0) for i in range(1, len(TIERS) + 1)), F.lit(0))
    worse = sum((F.when(F.col("_t") < i, F.col(f"_b{i}")).otherwise(0) for i in range(1, len(TIERS) + 1)), F.lit(0))
    return x.groupBy("query_id").agg(F.sum(other).cast("long").alias("pairs"), F.sum(worse).cast("long").alias("inverted"))


def revise_gate(unclear: Column, n: Column, one_in: int = 3) -> Column:
    """Whether too many rows couldn't be told."""
    return F.when(unclear * one_in > n, "REVISE").otherwise("PROCEED")


def stop_gate(k: Column, n: Column, size: int = 15) -> Column:
    """Verdict on ``k`` of a batch of exactly ``size``; null for any other size."""
    return F.when(n == size, F.when(k <= 7, "STOP").when(k <= 10, "CONTINUE_FLAGGED").otherwise("CONTINUE"))


def distribution(draws: DataFrame, value: str, least: int = 200) -> DataFrame:
    """Mean, sample deviation and range over seeds; fewer than ``least`` draws raise."""
    d = draws.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("low"), F.max(value).alias("high"))
    return d.select(F.when(F.col("n") >= least, F.col("n")).otherwise(F.raise_error(F.lit(f"fewer than {least} draws")).cast("long")).alias("n"), "mean", "sd", "low", "high")


def seeded_recalls(rows: DataFrame, gold: str, rate: float, seeds: int, key: str) -> DataFrame:
    """``seed, recall`` of independent draws at ``rate``, for each of ``seeds`` seeds; only gold rows can count."""
    draws = rows.filter(F.col(gold)).select(F.col(key).cast("string").alias("_k"), F.explode(F.sequence(F.lit(1), F.lit(seeds))).alias("seed"))
    hit = seeded_uniform(F.col("seed").cast("string"), F.col("_k")) < rate
    return draws.groupBy("seed").agg(ratio(F.count_if(hit), F.count("*")).alias("recall"))


def error_overlaps(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """``label, missed, overlapped``: gold spans left over when equal ones are taken away one by one, and those of them that
    a left-over prediction of any label overlaps."""
    cols = ["paper_id", "label", "start", "end"]
    g, p = gold.select(*cols), predicted.select(*cols)
    fn = g.exceptAll(p).groupBy(*cols).agg(F.count("*").alias("n"))
    fp = p.exceptAll(g).select("paper_id", "start", "end").distinct()
    near = overlap_counts(fn, fp, ["paper_id"]).filter("n > 0").drop("n", "equal")
    met = fn.join(near, ["paper_id", "start", "end"], "left_semi").groupBy("label").agg(F.sum("n").alias("overlapped"))
    return fn.groupBy("label").agg(F.sum("n").alias("missed")).join(met, "label", "left").na.fill(0, ["overlapped"])


def granted_scores(rows: DataFrame, gold: Column, predicted: Column, grants: dict[str, Column]) -> DataFrame:
    """Scores of the predictions and of their union with each grant, by ``variant``.

    ``rows`` are distinct and hold all that is gold, predicted or granted; which of these a row is, is said by conditions on it. So rows are counted where
    they are, by the few combinations of conditions, and none is sent on.
    """
    from .scoring import tallied

    flags = {"_gold": gold, "_none": predicted, **{f"_{name}": condition for name, condition in grants.items()}}
    cells = rows.groupBy(*[F.coalesce(c, F.lit(False)).alias(k) for k, c in flags.items()]).agg(F.count("*").alias("_k")).filter(" or ".join(f"`{k}`" for k in flags))
    granted = F.explode(F.array(*[F.struct(F.lit(name).alias("variant"), (F.col("_none") | F.col(f"_{name}")).alias("_p")) for name in ("none", *grants)])).alias("_v")
    return tallied(cells.select("_gold", "_k", granted).select("_gold", "_k", "_v.*").filter("_gold or _p"), F.col("_gold"), F.col("_p"), ["variant"], F.col("_k"))


def unmatched(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Keys that stand on one side only, with the side; none means that rows and labels match one to one."""
    a, b = left.select(*key).distinct().withColumn("_l", F.lit(True)), right.select(*key).distinct().withColumn("_r", F.lit(True))
    both = a.join(b, key, "full_outer")
    return both.filter("_l is null or _r is null").select(*key, F.when(F.col("_l").isNull(), "right").otherwise("left").alias("side"))


def repeated(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def upsert(base: DataFrame, update: DataFrame, key: list[str]) -> DataFrame:
    """``base`` with rows of ``update`` in the place of those of the same key."""
    return base.join(update.select(*key).distinct(), key, "left_anti").unionByName(update)


def distractors(ranked: DataFrame, seed: str) -> DataFrame:
    """``query_id, key``: one group of another query for each query that has a donor, never one of its own.

    Rows meet their successor in seeded order within a bucket of draws; no query meets all others.
    """
    draw = F.md5(F.concat_ws("|", F.lit(seed), F.col("query_id").cast("string"), "key"))
    order = Window.partitionBy(F.substring("_draw", 1, 2)).orderBy("_draw", "query_id", "key")
    x = ranked.select("query_id", "key", draw.alias("_draw")).withColumn("_donor", F.lead(F.struct("query_id", "key")).over(order))
    other = x.filter("_donor.query_id <> query_id").select("query_id", F.col("_donor.key").alias("key"), "_draw")
    return first_by(other.join(ranked.select("query_id", "key"), ["query_id", "key"], "left_anti"), ["query_id"], ["_draw"]).select("query_id", "key")


def controls(mentions: DataFrame, seed: str) -> DataFrame:
    """``text, canonical_id, control_id``: for each linked surface a concept of another surface of its label, as a mispaired control.

    Donors are the successors in seeded order within a bucket of draws; a surface's own concepts are never its control.
    """
    e = mentions.select("text", "canonical_id", "label").distinct().withColumn("_draw", F.md5(F.concat_ws("|", F.lit(seed), "text", "canonical_id")))
    order = Window.partitionBy("label", F.substring("_draw", 1, 2)).orderBy("_draw", "text", "canonical_id")
    x = e.withColumn("_other", F.lead(F.struct("text", "canonical_id")).over(order)).filter("_other.canonical_id <> canonical_id and _other.text <> text")
    own = e.select("text", F.col("canonical_id").alias("control_id")).distinct()
    return x.select("text", "canonical_id", F.col("_other.canonical_id").alias("control_id")).join(own, ["text", "control_id"], "left_anti").select("text", "canonical_id", "control_id")


#: Rates of the random baselines, in tenths.
RATES = (1, 2, 3, 4, 5, 6)


def baseline_sweep(sentences: DataFrame, gold: DataFrame, seeds: int = 200) -> DataFrame:
    """``selector, n, mean, sd, low, high``: recall of every positional baseline, once, and of the random ones over all seeds.

    All seeds and rates are one job: each gold sentence meets the seeds, and one draw a seed serves all rates.
    """
    marked = sentences.select("paper_id", "sentence_index").join(gold.select("paper_id", "sentence_index").distinct(), ["paper_id", "sentence_index"], "left_semi")
    each = marked.withColumn("seed", F.explode(F.sequence(F.lit(1), F.lit(seeds))))
    u = seeded_uniform(F.col("seed").cast("string"), F.col("paper_id").cast("string"), F.col("sentence_index").cast("string"))
    counted = each.withColumn("_u", u).groupBy("seed").agg(F.count("*").alias("_n"), *[F.count_if(F.col("_u") < F.lit(p / 10)).alias(f"rate_{p}") for p in RATES])
    long = counted.select(F.explode(F.array(*[F.struct(F.lit(f"rate_{p}").alias("selector"), ratio(F.col(f"rate_{p}"), F.col("_n")).alias("recall")) for p in RATES])).alias("x")).select("x.*")
    swept = long.groupBy("selector").agg(F.count("*").alias("n"), F.avg("recall").alias("mean"), F.stddev_samp("recall").alias("sd"), F.min("recall").alias("low"), F.max("recall").alias("high"))
    fixed = score_positions(sentences, gold)
    r = F.col("recall")
    return swept.unionByName(fixed.select("selector", F.lit(1).cast("long").alias("n"), r.alias("mean"), F.lit(None).cast("double").alias("sd"), r.alias("low"), r.alias("high")))
