"""Closed-form statistics as column arithmetic. A ratio over nothing is 0.0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The normal quantile of a 95 % interval, and the natural prevalence used in projection.
Z95, PREVALENCE = 1.959963984540054, 0.0252


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b.cast("double"))


def prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return p, r, F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Interval of a share; exactly 0 or 1 at the ends, and (0, 1) of nothing."""
    kd, nd = k.cast("double"), n.cast("double")
    p, zz = kd / nd, z * z
    centre, half = p + zz / (2 * nd), z * F.sqrt(p * (1 - p) / nd + zz / (4 * nd * nd))
    low = F.when((n == 0) | (k == 0), 0.0).otherwise((centre - half) / (1 + zz / nd))
    high = F.when((n == 0) | (k == n), 1.0).otherwise((centre + half) / (1 + zz / nd))
    return low, high


def mcnemar(b: Column, c: Column) -> Column:
    """Exact two-sided binomial test on discordant counts, in log space, at most 1; 1 without any."""
    n, k = (b + c).cast("int"), F.least(b, c).cast("int")
    logs = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1))), lambda i: F.when(i == 0, 0.0).otherwise(F.log(i.cast("double"))))
    tail = F.aggregate(
        F.sequence(F.lit(0), k),
        F.struct(F.lit(0.0).alias("term"), F.lit(0.0).alias("sum")),
        lambda s, i: F.struct(
            F.when(i == 0, s.term).otherwise(s.term + F.get(logs, n - i + 1) - F.get(logs, i)).alias("term"),
            (s["sum"] + F.exp(F.when(i == 0, s.term).otherwise(s.term + F.get(logs, n - i + 1) - F.get(logs, i)) - n * F.log(F.lit(2.0)))).alias("sum"),
        ),
        lambda s: s["sum"],
    )
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def project(recall: Column, specificity: Column, prevalence: float = PREVALENCE) -> Column:
    """Precision at another prevalence, by Bayes' rule."""
    hit, false = recall * prevalence, (1 - specificity) * (1 - prevalence)
    return F.when(hit + false == 0, 0.0).otherwise(hit / (hit + false))
