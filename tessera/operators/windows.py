"""Text windows under a budget, and the spans found in them."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import written
from .linking import drop_contained
from .pairing import first_by


def _furthest(text: str, start: int, cuts: Sequence[int], cost: Callable[[str], int], budget: int) -> int | None:
    """The last cut up to which the text from ``start`` is within the budget."""
    n = bisect_right(cuts, budget, key=lambda c: cost(text[start:c]))
    return cuts[n - 1] if n else None


def plan(text: str, ends: list[tuple[int, int]], cost: Callable[[str], int], budget: int, overlap: int = 1) -> list[tuple[int, int]]:
    """Windows of whole sentences (``ends``: their spans), each within the budget, that share ``overlap`` sentences.

    A sentence over the budget is cut at white space, and a word over it anywhere; such pieces share nothing. ``cost`` must not fall as a text grows.
    """
    out, i = [], 0
    while i < len(ends):
        start = ends[i][0]
        stop = _furthest(text, start, [e for _, e in ends[i:]], cost, budget)
        if stop is None:
            end = ends[i][1]
            words = [p for p in range(start + 1, end) if text[p - 1].isspace() and not text[p].isspace()] + [end]
            while start < end:
                cut = _furthest(text, start, [w for w in words if w > start], cost, budget) or _furthest(text, start, range(start + 1, end + 1), cost, budget) or start + 1
                out.append((start, cut))
                start = cut
            i += 1
            continue
        out.append((start, stop))
        j = next(k for k in range(i, len(ends)) if ends[k][1] == stop) + 1
        if j == len(ends):
            break
        back = max(j - overlap, i + 1)
        i = next((k for k in range(back, j) if cost(text[ends[k][0] : ends[j][1]]) <= budget), j)
    return out


#: Words are runs of anything but ASCII white space.
_WORD = r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"


def plan_windows(sentences: DataFrame, budget: int = 450, overlap: int = 1) -> DataFrame:
    """``paper_id, window, start, end``: the windows of ``plan`` for a budget in words, from ``paper_id, sentence_index, start, end, text``.

    Where one window ends decides where the next starts. Each sentence gets a pointer to the sentence at which the next window would
    start: the furthest end within the budget is found by a range frame over the running number of words, and steps back for the overlap by as
    many lags. Which pointers are followed from a text's first sentence is found by doubling: in round k the visited sentences jump 2 ** k windows
    at once, so a text of n windows takes log n rounds of equi-joins, all texts together. No text is planned in one task, and nothing in Python.
    Sentences of a text mustn't overlap, and white space parts them.
    """
    if budget < 1 or overlap < 0:
        raise ValueError("budget is above 0, overlap not below")
    by = Window.partitionBy("paper_id").orderBy("sentence_index")
    parts = F.regexp_extract_all("text", F.lit(_WORD), F.lit(0))
    s = sentences.select("paper_id", "sentence_index", "start", "end", parts.alias("_parts")).withColumn("i", F.row_number().over(by) - 1)
    s = written(s.withColumn("w", F.size("_parts")).withColumn("to", F.sum("w").over(by)).withColumn("at", F.col("to") - F.col("w")))
    # the place behind the last sentence is a place too, at which all words have gone by
    stop = s.groupBy("paper_id").agg((F.max("i") + 1).alias("i"), F.max("to").alias("at"))
    places = s.select("paper_id", "i", "at", "to").unionByName(stop.withColumn("to", F.col("at")))
    ahead = Window.partitionBy("paper_id").orderBy("at").rangeBetween(Window.currentRow, budget)
    order = Window.partitionBy("paper_id").orderBy("i")
    back = [F.when(F.col("to") - F.lag("at", k).over(order) <= budget, F.col("i") - k) for k in range(overlap, 0, -1)]
    reached = places.withColumn("j", F.max("i").over(ahead)).withColumn("again", F.coalesce(*back, F.col("i")))
    n = stop.select("paper_id", F.col("i").alias("n"))
    here = reached.join(n, "paper_id").filter("i < n").select("paper_id", "i", "j", "n")
    again = reached.select("paper_id", F.col("i").alias("j"), "again")
    # a sentence beyond the budget reaches nothing but itself
    following = F.when(F.col("j") <= F.col("i"), F.col("i") + 1).when(F.col("j") < F.col("n"), F.greatest("again", F.col("i") + 1))
    jumps = written(here.join(again, ["paper_id", "j"]).select("paper_id", "i", "j", following.alias("next")))
    seen = _followed(jumps)
    first = s.select("paper_id", "i", "start", "end", "_parts", "w")
    last = s.select("paper_id", (F.col("i") + 1).alias("j"), F.col("end").alias("stop"))
    picked = seen.join(jumps.select("paper_id", "i", "j"), ["paper_id", "i"]).join(first, ["paper_id", "i"])
    whole = picked.filter("j > i").join(last, ["paper_id", "j"]).select("paper_id", "start", F.col("stop").alias("end"))
    # pieces of a sentence: budget words each, white space with the word before it
    sizes = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / budget).cast("int")), lambda k: F.length(F.array_join(F.slice(p, k * budget + 1, budget), "")))
    cut = picked.filter("j <= i").select("paper_id", "start", "end", F.posexplode(sizes(F.col("_parts"))).alias("k", "size"))
    within = Window.partitionBy("paper_id", "start").orderBy("k")
    cut = cut.withColumn("stop", F.col("start") + F.sum("size").over(within)).select("paper_id", (F.col("stop") - F.col("size")).alias("start"), F.least("stop", "end").alias("end"))
    at = Window.partitionBy("paper_id").orderBy("start")
    return whole.unionByName(cut).select("paper_id", (F.row_number().over(at) - 1).cast("long").alias("window"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


def _followed(jumps: DataFrame) -> DataFrame:
    """``paper_id, i`` of the places that pointers ``next`` lead to from place 0, by doubling."""
    seen = jumps.filter("i = 0").select("paper_id", "i")
    leap = jumps.filter("next is not null").select("paper_id", "i", "next")
    longest = jumps.agg(F.max("i")).first()[0] or 0
    for _ in range(max(1, longest).bit_length()):
        seen = written(seen.unionByName(seen.join(leap, ["paper_id", "i"]).select("paper_id", F.col("next").alias("i"))).distinct())
        onward = leap.select("paper_id", F.col("i").alias("next"), F.col("next").alias("after"))
        leap = written(leap.join(onward, ["paper_id", "next"]).select("paper_id", "i", F.col("after").alias("next")))
    return seen


def best_spans(found: DataFrame) -> DataFrame:
    """Spans of all windows of a document, each once: the highest score wins, then the first window; contained ones go."""
    best = first_by(found, ["paper_id", "label", "start", "end"], [F.desc("score"), "window"])
    return drop_contained(best, ["paper_id", "label"])
