"""Seams for models that aren't part of the engine: extraction of sentences and judging of pairs by a caller's function.

A function is called once a row on the executors; what goes wrong is a column, not a counter on the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABELS = ("agreement", "contradiction", "insufficient_overlap")


def numbered(sentences: DataFrame) -> DataFrame:
    """``paper_id, prompt, n``: a text's sentences, one a line, each after its number."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("sentence_index", "text"))), lambda s: F.concat(F.lit("["), s.sentence_index.cast("string"), F.lit("] "), s.text))
    return sentences.groupBy("paper_id").agg(F.array_join(lines, "\n").alias("prompt"), F.count("*").alias("n"))


def extracted(sentences: DataFrame, choose: Callable[[str], list[int] | None]) -> DataFrame:
    """``paper_id, indices, out_of_range, status``: distinct chosen indices in order; those out of range are dropped and counted.

    ``choose`` returns None to refuse; an exception is a failed row, and the others go on.
    """
    rows = numbered(sentences)

    def one(prompt: str, n: int) -> tuple[list[int], int, str]:
        try:
            got = choose(prompt)
        except Exception as e:  # noqa: BLE001 - a provider may raise anything; the row says so
            return [], 0, f"error: {type(e).__name__}"
        if got is None:
            return [], 0, "refused"
        return sorted({i for i in got if 0 <= i < n}), sum(not 0 <= i < n for i in got), "ok"

    def run(frames):
        import pandas as pd

        for f in frames:
            yield pd.DataFrame([(p, *one(t, n)) for p, t, n in zip(f["paper_id"], f["prompt"], f["n"], strict=True)], columns=["paper_id", "indices", "out_of_range", "status"])

    return rows.mapInPandas(run, f"paper_id {sentences.schema['paper_id'].dataType.simpleString()}, indices array<int>, out_of_range int, status string")


def judged_by(pairs: DataFrame, judge: Callable[[str, str], str | None]) -> DataFrame:
    """``pairs`` (with ``text_a, text_b``) and the ``verdict`` of ``judge``, null where it refuses or names no known label."""
    known = F.col("verdict").isin(*LABELS)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema) + ", verdict string"

    def run(frames):
        for f in frames:
            yield f.assign(verdict=[judge(a, b) for a, b in zip(f["text_a"], f["text_b"], strict=True)])

    return pairs.mapInPandas(run, schema).withColumn("verdict", F.when(known, F.col("verdict")))
