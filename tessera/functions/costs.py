"""Spending: bounds from pilot rows, prices and even splits. Small by nature: a handful of arms and models."""

from __future__ import annotations

from datetime import date, timedelta
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def t_quantile(p: float, df: int) -> float:
    """Student's t quantile by the expansion around the normal one."""
    z = NormalDist().inv_cdf(p)
    terms = ((z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384)
    return z + sum(t / df**i for i, t in enumerate(terms, 1))


def upper_bound(mean: Column, sd: Column, n: Column, t: float) -> Column:
    return mean + t * F.coalesce(sd, F.lit(0.0)) / F.sqrt(n.cast("double"))


def bounds(arms: DataFrame, p: float = 0.95) -> DataFrame:
    """``arms, bound``: the sum of the upper bounds of all arms' means; degrees of freedom are the smallest arm's rows less one.

    Reads one number, the least count, to the driver.
    """
    least = arms.agg(F.min("n")).first()[0]
    if least is None or least < 2:
        raise ValueError("each arm needs two rows or more")
    each = upper_bound(F.col("mean"), F.col("sd"), F.col("n"), t_quantile(p, least - 1))
    return arms.agg(F.count("*").alias("arms"), F.round(F.sum(each), 6).alias("bound"))


def prices(table: dict[str, dict[str, float]], model: str, checked: date, today: date, days: int = 30) -> dict[str, float]:
    """A model's prices a token; an unknown model, or a table older than ``days``, raises."""
    if today - checked > timedelta(days=days):
        raise ValueError(f"prices of {checked} are older than {days} days")
    if model not in table:
        raise ValueError(f"no price for {model}")
    return {kind: per_million / 1_000_000 for kind, per_million in table[model].items()}


def split_evenly(total: int, parts: int) -> list[int]:
    """Sizes that add up to ``total``, the first ones larger by one where it doesn't divide."""
    return [total // parts + (i < total % parts) for i in range(parts)]
