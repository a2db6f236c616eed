"""Benchmark decontamination by Wu-Manber search over words: shift tables skip, suffix buckets select, comparison confirms.

A benchmark is searched block by block: one block of a bounded number of words is built, broadcast, searched in a pass over the
documents and dropped, and the hits of all passes are merged. A benchmark of one block, as usual, is one pass.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BATCH_ROWS, Cut, word_list

#: Words in a window, words in a block of the shift table, and most benchmark words that one search holds (some 300 bytes each).
WINDOW, BLOCK, HELD_WORDS = 13, 3, 300_000


class Search:
    """The tables for patterns of one length, runs of the items' words: a block's last distance to a pattern's end, and
    patterns by last block. Words are numbers, and a pattern is the place where it starts in the items' words."""

    def __init__(self, length: int):
        self.length, self.block = length, min(BLOCK, length)
        self.skip = length - self.block + 1
        self.number: dict[bytes, int] = {}
        self.words, self.item_ends, self.names = array("i"), array("i"), []
        self.shift: dict[int, int] = {}
        self.bucket: dict[int, array] = {}

    def add(self, name: str, words: list[bytes]) -> None:
        """An item; all its runs of ``length`` words are patterns."""
        number, base, m, b = self.number, len(self.words), self.length, self.block
        self.words.extend([number.setdefault(w, len(number)) for w in words])
        self.item_ends.append(len(self.words))
        self.names.append(name)
        shift = self.shift
        for i in range(len(words) - b + 1):
            key = self._key(self.words[base + i : base + i + b])
            # patterns end everywhere from word m on: the next end is here, or at m
            shift[key] = min(shift.get(key, self.skip), max(m - i - b, 0))
            if i + b >= m:
                self.bucket.setdefault(key, array("i")).append(base + i + b - m)

    @staticmethod
    def _key(numbers: Iterable[int]) -> int:
        key = 0
        for x in numbers:
            key = key << 32 | x
        return key

    def _item(self, place: int) -> str:
        lo, hi = 0, len(self.item_ends)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if self.item_ends[mid] <= place else (lo, mid)
        return self.names[lo]

    def find(self, words: list[bytes]) -> Iterator[tuple[int, list[str]]]:
        """Start and items of every occurrence."""
        at, n, m, b = self.length, len(words), self.length, self.block
        number, shift, skip = self.number.get, self.shift.get, self.skip
        while at <= n:
            key = 0
            for w in words[at - b : at]:
                x = number(w)
                if x is None:
                    key = -1
                    break
                key = key << 32 | x
            step = shift(key, skip)
            if step:
                at += step
                continue
            here = array("i", [number(w, -1) for w in words[at - m : at]])
            names = [self._item(p) for p in self.bucket[key] if self.words[p : p + m] == here]
            if names:
                yield at - m, names
            at += 1


def build(items: Iterable[tuple[object, str | None]], window: int = WINDOW) -> list[Search]:
    """Searches by pattern length. An item shorter than a window is one pattern, an empty one none."""
    by_length: dict[int, Search] = {}
    for item, text in items:
        words = word_list(text)
        m = min(window, len(words))
        if m:
            by_length.setdefault(m, Search(m)).add("null" if item is None else str(item), words)
    return [s for _, s in sorted(by_length.items())]


def hits(words: list[bytes], searches: list[Search]) -> tuple[list[tuple[int, int]], set[str]]:
    """Ranges of hit words, merged, and the items that occur."""
    found, items = [], set()
    for s in searches:
        for start, names in s.find(words):
            found.append((start, start + s.length))
            items.update(names)
    return merge(found), items


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _search_pass(df: DataFrame, shared: Broadcast, text: str, names: list[str], more: bool, keep_text: bool) -> DataFrame:
    """``df`` with the columns ``names``: words, hit words, ranges of hits and sorted items of each text, those of earlier passes merged in."""
    kept = [c for c in df.columns if c not in names and (keep_text or c != text)]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(n, T._parse_datatype_string(t)) for n, t in zip(names, ("long", "long", "array<long>", "array<string>"), strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                column = lambda c, part=part: part.column(part.schema.get_field_index(c))
                out = [[], [], [], []]
                before = zip(column(names[2]).to_pylist(), column(names[3]).to_pylist(), strict=True) if more else None
                for t in column(text).to_pylist():
                    words = word_list(t)
                    ranges, items = hits(words, shared.value)
                    if before:
                        old, old_items = next(before)
                        ranges, items = merge(ranges + [(x >> 32, x & 0xFFFFFFFF) for x in old]), items.union(old_items)
                    for column_out, v in zip(out, (len(words), sum(b - a for a, b in ranges), [a << 32 | b for a, b in ranges], sorted(items)), strict=True):
                        column_out.append(v)
                arrays = [pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string())), strict=True)]
                yield pa.RecordBatch.from_arrays([*map(column, kept), *arrays], names=kept + names)

    return df.mapInArrow(run, schema)


def _pieces(sized: DataFrame, size: int) -> DataFrame:
    """``item, text, n``: long items in pieces of ``size`` words that share ``WINDOW - 1`` words, so that each window is in one; equal rows once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i, t in enumerate(batch.column(1).to_pylist()):
                words = word_list(t)
                starts = range(0, len(words) - WINDOW + 1, size - WINDOW + 1) if len(words) > size else [0]
                rows += [(i, b" ".join(words[s : s + size]).decode("utf-8", "replace"), min(size, len(words) - s)) for s in starts]
            at, texts, n = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(texts, pa.string()), pa.array(n, pa.int64())], names=["item", "text", "n"])

    return sized.mapInArrow(run, T.StructType([sized.schema["item"], T.StructField("text", T.StringType()), T.StructField("n", T.LongType())])).distinct()


def _blocks(benchmark: DataFrame, item: str, text: str, held_words: int) -> list[DataFrame]:
    """The benchmark dealt by a hash into as many parts of about ``held_words`` words as its words ask for. Long items are cut into pieces first,
    so that one item, of any length, is spread as well."""
    sized = benchmark.select(F.col(item).alias("item"), F.col(text).alias("text"))
    # a word and what parts it from the next take two bytes at least
    if (sized.agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= 2 * held_words:
        return [sized]
    pieces = Cut(_pieces(sized, max(2 * WINDOW, held_words // 8)))
    n = 1 + int(pieces.df.agg(F.sum("n")).first()[0] or 0) // held_words
    return [pieces.df.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).select("item", "text") for k in range(n)]


def with_hits(docs: DataFrame, benchmark: DataFrame, names: list[str], text: str = "text", keep_text: bool = True, held_words: int = HELD_WORDS) -> DataFrame:
    """``docs`` with four columns: words, hit words, ranges of hits, items. A block's rows come to the driver by partitions; all blocks
    but the last are searched at once, each into a written table that the next pass reads and replaces."""
    blocks, spark = _blocks(benchmark, "item_id", "text", held_words), docs.sparkSession
    now, before = docs, None
    for k, rows in enumerate(blocks):
        shared = spark.sparkContext.broadcast(build((r.item, r.text) for r in rows.toLocalIterator()))
        last = k == len(blocks) - 1
        found = _search_pass(now, shared, text, names, k > 0, keep_text or not last)
        if last:
            return found
        after = Cut(found)
        shared.destroy()
        if before:
            before.drop()
        now, before = after.df, after
    raise AssertionError("there is one block at least")


def _contaminated(n_words: str, n_hit: str) -> Column:
    return (F.col(n_hit) > 0) & (F.col(n_hit) * 20 >= F.col(n_words))


def find_contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", held_words: int = HELD_WORDS) -> DataFrame:
    """One row per document row: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``.

    A null or empty text has no words and is not contaminated. Items that repeat a text all count.
    An empty benchmark hits nothing.
    """
    names = ["n_words", "n_hit", "ranges", "items"]
    found = with_hits(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), benchmark, names, keep_text=False, held_words=held_words)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), _contaminated("n_words", "n_hit").alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", held_words: int = HELD_WORDS) -> DataFrame:
    """Rows of ``docs``, with all their columns, whose text is not contaminated."""
    names = ["hit_words", "hits", "hit_ranges", "hit_items"]
    while set(names) & {c.lower() for c in docs.columns}:
        names = [n + "_" for n in names]
    return with_hits(docs, benchmark, names, text, held_words=held_words).filter(~_contaminated(*names[:2])).select(*docs.columns)
