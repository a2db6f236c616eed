"""Walks along an array inside a row: what a window would give for rows, without a shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Items of an array that one step of a walk grows an array by.
STEP = 256


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def walk(items: Column, start: Column, step: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column]) -> Column:
    """Array of ``emit(state, item)`` along ``items``, where ``step(state, item)`` is the next state.

    Expressions can only append by copying, so results are gathered ``STEP`` at a time and the pieces joined once: time
    grows as the number of items, not as its square. ``items`` is named more than once; bind it if it costs anything.
    """
    empty = F.transform(F.slice(items, 1, 0), lambda x: emit(start, x))
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / STEP).cast("int")), lambda i: F.slice(items, i * STEP + 1, STEP))

    def piece(s: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(s.at.alias("at"), empty.alias("out")), lambda t, x: F.struct(step(t.at, x).alias("at"), F.concat(t.out, F.array(emit(t.at, x))).alias("out")))
        return bound(inner, lambda r: F.struct(r.at.alias("at"), F.concat(s.outs, F.array(r.out)).alias("outs")))

    walked = F.aggregate(pieces, F.struct(start.alias("at"), F.transform(F.slice(pieces, 1, 0), lambda x: empty).alias("outs")), piece, lambda s: F.flatten(s.outs))
    return F.when(F.size(items) > 0, walked).otherwise(empty)
