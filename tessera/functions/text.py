"""Text expressions. Offsets are code points throughout."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .arrays import bound

#: Texts that are searched at once.
ROWS = 500
#: A sentence ends at the white space after a full stop, exclamation or question mark; that space is in no sentence.
SENTENCE_GAP = r"(?<=[.!?])[ \t\n\x0b\f\r]+"
_GAP = regex.compile(SENTENCE_GAP)


def normalize_surface(s: Column) -> Column:
    """Trimmed, inner white space collapsed, case-folded for the letters whose fold is not their lower case."""
    folded = F.lower(F.trim(F.regexp_replace(s, r"(?U)\s+", " ")))
    return F.replace(F.replace(folded, F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def found_in(rows: DataFrame, key: str, text: str, fields: str, find: Callable[[str], Iterator[tuple]]) -> DataFrame:
    """``key`` and what ``find`` gives for each text, row by row; nothing for a null text.

    Spark's expressions return matches without their places, and places as running sums over an array cost several times what the search does. So
    texts go through Arrow, ``ROWS`` at a time.
    """
    schema = T.StructType([rows.schema[key], *T._parse_datatype_string(fields)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                got = [list(find(t)) if t is not None else [] for t in part.column(1).to_pylist()]
                own = part.column(0).take(pa.array(np.repeat(np.arange(len(got)), [len(g) for g in got])))
                columns = zip(*(x for g in got for x in g), strict=True) if any(got) else [[]] * (len(arrow) - 1)
                yield pa.RecordBatch.from_arrays([own, *(pa.array(c, f.type) for c, f in zip(columns, list(arrow)[1:], strict=True))], schema=arrow)

    return rows.select(key, text).mapInArrow(run, schema)


def _spans(text: str) -> Iterator[tuple[int, int, int]]:
    """Number, start and end of the sentences: an empty text has an empty one, a trailing gap adds none."""
    at = n = 0
    for n, gap in enumerate(_GAP.finditer(text)):
        yield n, at, gap.start()
        at, n = gap.end(), n + 1
    if at < len(text) or not n:
        yield n, at, len(text)


def pieces(rows: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """``key, pos, match, start, end`` of every match of ``pattern`` in ``text``, row by row: rows of one key don't mix. Offsets are in code points."""
    sought = regex.compile(pattern)
    return found_in(rows, key, text, "pos int, match string, start int, end int", lambda t: ((i, m[0], m.start(), m.end()) for i, m in enumerate(sought.finditer(t))))


def sentences(rows: DataFrame, key: str = "paper_id", text: str = "abstract") -> DataFrame:
    """``key, sentence_index, start, end, text``, row by row."""
    return found_in(rows, key, text, "sentence_index int, start int, end int, text string", lambda t: ((n, a, b, t[a:b]) for n, a, b in _spans(t)))


def sentence_pieces(rows: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """``key, sentence_index, match, start, end`` of matches, offsets in the whole text, for a ``pattern`` that matches no white space:
    each sentence is searched by itself, so a match has its sentence without a join."""
    sought = regex.compile(pattern)
    return found_in(rows, key, text, "sentence_index int, match string, start int, end int", lambda t: ((n, m[0], m.start(), m.end()) for n, a, b in _spans(t) for m in sought.finditer(t, a, b)))


def numerals(s: Column) -> Column:
    """Numbers that are no part of a word or a longer number, repeats kept."""
    return F.regexp_extract_all(s, F.lit(r"(?<![\w.])\d+(?:\.\d+)?"), F.lit(0))


def shingles(s: Column, size: int = 10, stride: int = 5) -> Column:
    """Windows of ``size`` words at every ``stride``-th word, white space normalised; a shorter text has none."""
    words = F.filter(F.split(s, r"\s+"), lambda w: w != "")

    def windows(w: Column) -> Column:
        starts = F.when(F.size(w) >= size, F.sequence(F.lit(1), F.size(w) - size + 1, F.lit(stride))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(w, i, size), " "))

    return bound(words, windows)


def contains_phrase(words: Column, phrase: Column) -> Column:
    """Whether one array of words stands in another as a run; an empty phrase never does."""
    k = F.size(phrase)
    starts = F.when((k > 0) & (F.size(words) >= k), F.sequence(F.lit(1), F.size(words) - k + 1)).otherwise(F.array().cast("array<int>"))
    return F.exists(starts, lambda i: F.slice(words, i, k) == phrase)


def seeded_uniform(*parts: Column) -> Column:
    """A draw in [0, 1) that depends on the values alone, so neither on partitions nor on retries."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)
