"""Relations of papers by key, where a key is two concepts: dealt as papers' concepts over a grid of cells, not as relations.

A paper's relations are among the product of its concepts, of which there are far fewer. A cell is a block of left concepts and
one of right concepts; a paper's concepts of both blocks go to it. So all relations of a key meet in one cell, without a row
for any of them. In a cell they are made slice by slice, and most end there, as their key has one paper alone.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import written

#: Concepts of a cell, about, and concept pairs of a cell that are made at once.
CELL_CONCEPTS, SLICE_PAIRS = 16_000_000, 2_000_000
#: Directions of a relation in numbers: none where it isn't one, else one or both.
NONE, CAUSES, TREATS, BOTH = range(4)

#: From paper ids and their left and right concepts, as numbers, the directions of the relation.
Rule = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def paper_concepts(linked: DataFrame, number: Callable[[Column], Column]) -> DataFrame:
    """``paper_id, lefts, rights``: the linked chemicals and diseases of a paper, as numbers; papers that lack either have no pair and go."""
    of = lambda label: F.collect_set(F.when(F.col("label") == label, number(F.col("canonical_id"))))
    each = linked.filter("canonical_id is not null and paper_id is not null").groupBy("paper_id").agg(of("CHEMICAL").alias("lefts"), of("DISEASE").alias("rights"))
    return each.filter((F.size("lefts") > 0) & (F.size("rights") > 0))


def _block(x: np.ndarray, blocks: int) -> np.ndarray:
    return ((x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % blocks


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and values of an array column."""
    ends = column.offsets.to_numpy()
    return np.diff(ends), column.values.to_numpy()[ends[0] : ends[-1]]


_DEALT = pa.schema([("cell", pa.int32()), ("papers", pa.list_(pa.int64())), ("facts", pa.list_(pa.string())), ("n_left", pa.list_(pa.int32())), ("n_right", pa.list_(pa.int32())), ("lefts", pa.list_(pa.int32())), ("rights", pa.list_(pa.int32()))])


def in_cells(papers: DataFrame) -> DataFrame:
    """``papers`` of ``paper_id, fact, lefts, rights``, one row a paper, dealt over the grid: a partition a cell, whose rows hold several papers each.

    ``fact`` is a text that travels with a paper.
    """
    spark = papers.sparkSession
    n = papers.agg(F.coalesce(F.sum(F.size("lefts") + F.size("rights")), F.lit(0)).alias("n")).first().n
    blocks = max(math.ceil(math.sqrt(2 * spark.sparkContext.defaultParallelism)), -(-n // CELL_CONCEPTS))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            sides = []
            for name in ("lefts", "rights"):
                size, values = _lists(batch.column(name))
                at, to = np.repeat(np.arange(rows), size), _block(values, blocks)
                sides.append([(at[to == i], values[to == i]) for i in range(blocks)])
            has = [[np.bincount(at, minlength=rows) for at, _ in side] for side in sides]
            for i in range(blocks):
                for j in range(blocks):
                    both = (has[0][i] > 0) & (has[1][j] > 0)
                    if not both.any():
                        continue
                    named = pa.array(np.flatnonzero(both))
                    own = [batch.column("paper_id").take(named), batch.column("fact").take(named), has[0][i][both].astype(np.int32), has[1][j][both].astype(np.int32), *(x[both[at]] for at, x in (sides[0][i], sides[1][j]))]
                    columns = [pa.array([i * blocks + j], pa.int32()), *(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, f.type.value_type)) for x, f in zip(own, list(_DEALT)[1:], strict=True))]
                    yield pa.RecordBatch.from_arrays(columns, schema=_DEALT)

    rows = papers.select(F.col("paper_id").cast("long").alias("paper_id"), F.col("fact").cast("string").alias("fact"), "lefts", "rights")
    dealt = rows.mapInArrow(deal, "cell int, papers array<long>, facts array<string>, n_left array<int>, n_right array<int>, lefts array<int>, rights array<int>")
    return dealt.repartitionById(blocks * blocks, F.col("cell"))


class Cell:
    """The papers of a cell, by id, with their concepts as places in sorted lists."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        found: list[list] = [[] for _ in list(_DEALT)[1:]]
        for batch in batches:
            for mine, f in zip(found, list(_DEALT)[1:], strict=True):
                mine.append(batch.column(f.name).flatten())
        self.empty = not found[0]
        if self.empty:
            return
        papers, facts, n_left, n_right, lefts, rights = (pa.concat_arrays(x) for x in found)
        order = np.argsort(papers.to_numpy(), kind="stable")
        self.papers, self.facts = papers.to_numpy()[order], facts.take(pa.array(order))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.lefts, self.left_of, self.left_at = self._side(n_left.to_numpy(), lefts.to_numpy(), place)
        self.rights, self.right_of, self.right_at = self._side(n_right.to_numpy(), rights.to_numpy(), place)

    @staticmethod
    def _side(size: np.ndarray, values: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct concepts, and for each entry its place among them and its paper, in the order of papers."""
        distinct, of = np.unique(values, return_inverse=True)
        at = np.repeat(place, size)
        order = np.argsort(at, kind="stable")
        return distinct, of[order], at[order]

    def pairs(self, most: int = SLICE_PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``(key, paper)`` slice by slice: every concept pair of every paper as numbers, by key and paper; all of a key are in one slice.

        A slice has about ``most`` of them: some left concepts with all right ones, or with a part of these where one left concept alone has too many pairs.
        """
        n = len(self.papers)
        rights = np.bincount(self.right_at, minlength=n)
        weight = np.bincount(self.left_of, weights=rights[self.left_at], minlength=len(self.lefts))
        parts = max(1, math.ceil(weight.max() / most))
        slice_of = (np.cumsum(weight / parts) / most).astype(np.int64)
        order = np.argsort(slice_of[self.left_of], kind="stable")
        ends = np.flatnonzero(np.diff(slice_of[self.left_of][order])) + 1
        for part in range(parts):
            mine = self.right_of % parts == part
            right_of, at = self.right_of[mine], self.right_at[mine]
            size = np.bincount(at, minlength=n)
            start = np.cumsum(size) - size
            for entries in np.split(order, ends):
                paper = self.left_at[entries]
                each = size[paper]
                total = int(each.sum())
                if total:
                    right = right_of[np.arange(total) + np.repeat(start[paper] - (np.cumsum(each) - each), each)]
                    key = np.repeat(self.left_of[entries].astype(np.int64) * len(self.rights), each) + right
                    low = int(key.min())
                    if (int(key.max()) - low + 1) * n < 2**63:
                        packed = np.sort((key - low) * n + np.repeat(paper, each))
                        yield packed // n + low, packed % n
                    else:
                        paper = np.repeat(paper, each)
                        by = np.lexsort((paper, key))
                        yield key[by], paper[by]

    def concepts(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.lefts[key // len(self.rights)], self.rights[key % len(self.rights)]


def _again(key: np.ndarray) -> np.ndarray:
    """Whether a key of sorted ones has more than one row."""
    same = key[1:] == key[:-1]
    return np.concatenate((same, [False])) | np.concatenate(([False], same)) if len(key) else np.empty(0, bool)


def _rank(*sorted_by: np.ndarray) -> np.ndarray:
    """How many rows stand before each in its group, of rows sorted by the columns of the group."""
    n = len(sorted_by[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for x in sorted_by:
        new[1:] |= x[1:] != x[:-1]
    start = np.flatnonzero(new)
    return np.arange(n) - np.repeat(start, np.diff(start, append=n))


def first_pairs(key: np.ndarray, paper: np.ndarray, one_way: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``key, a, b, agree``: the first ``cap`` pairs of a key with equal directions, and with unequal ones, by (a, b); from rows by key and paper, with one direction each.

    They only hold papers among the first ``cap + 1`` of a direction (:func:`corpora.candidate_pairs`).
    """
    by = np.lexsort((paper, one_way, key))
    few = np.sort(by[_rank(key[by], one_way[by]) <= cap])
    key, paper, one_way = key[few], paper[few], one_way[few]
    rows = [np.flatnonzero(key[j:] == key[:-j]) for j in range(1, 2 * cap + 2) if j < len(key)]
    a = np.concatenate(rows) if rows else np.empty(0, np.int64)
    b = a + np.repeat(np.arange(1, len(rows) + 1), [len(x) for x in rows]) if rows else a
    agree = one_way[a] == one_way[b]
    by = np.lexsort((b, a, agree, key[a]))
    by = by[_rank(key[a][by], agree[by]) < cap]
    return key[a][by], paper[a][by], paper[b][by], agree[by]


_PAIRS = pa.schema([("left", pa.int32()), ("right", pa.int32()), ("paper_a", pa.int64()), ("paper_b", pa.int64()), ("agree", pa.bool_()), ("fact_a", pa.string()), ("fact_b", pa.string()), ("ways_a", pa.int32()), ("ways_b", pa.int32())])


def candidate_pairs(papers: DataFrame, rule: Rule, cap: int = 4, most: int = SLICE_PAIRS) -> DataFrame:
    """``left, right, paper_a, paper_b, agree, fact_a, fact_b, ways_a, ways_b``: :func:`corpora.candidate_pairs` of the relations that ``rule`` finds among the concepts of ``papers``.

    ``papers`` are as :func:`in_cells` takes them. A pair comes with its papers' facts and with the directions of its relations, looked up again among all of the key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = Cell(batches)
        for key, paper in cell.pairs(most) if not cell.empty else ():
            held = _again(key)
            key, paper = key[held], paper[held]
            ways = rule(cell.papers[paper], *cell.concepts(key))
            one = (ways == CAUSES) | (ways == TREATS)
            k, a, b, agree = first_pairs(key[one], paper[one], ways[one], cap)
            low, n = int(key[0]) if len(key) else 0, len(cell.papers)
            found = [ways[np.searchsorted((key - low) * n + paper, (k - low) * n + x)] for x in (a, b)]
            left, right = cell.concepts(k)
            for i in range(0, len(k), 1 << 16):
                s = slice(i, i + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((left[s], right[s], cell.papers[a[s]], cell.papers[b[s]], agree[s], cell.facts.take(pa.array(a[s])), cell.facts.take(pa.array(b[s])), *(x[s] for x in found)), _PAIRS, strict=True)], schema=_PAIRS)

    return in_cells(papers).mapInArrow(run, "left int, right int, paper_a long, paper_b long, agree boolean, fact_a string, fact_b string, ways_a int, ways_b int")


def _flat(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places ``start, start + 1, ...``, as many as ``size`` says, of each entry, and the entry of each."""
    of = np.repeat(np.arange(len(size)), size)
    return np.arange(len(of)) + np.repeat(start - (np.cumsum(size) - size), size), of


def members(papers: DataFrame, rule: Rule) -> DataFrame:
    """``kind, concept, paper_id``: the left concepts (``kind`` 0) and right ones (1) of each paper that have a relation in it, which is looked for until one is found."""
    schema = pa.schema([("kind", pa.int32()), ("concept", pa.int32()), ("paper_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("paper_id").to_numpy()
            sides = [_lists(batch.column(name)) for name in ("lefts", "rights")]
            for kind in (0, 1):
                (size, own), (others, values) = sides[kind], sides[1 - kind]
                at = np.repeat(np.arange(len(ids)), size)
                first = (np.cumsum(others) - others)[at]
                found, open_, low, step = np.zeros(len(at), bool), np.arange(len(at)), 0, 4
                while len(open_):
                    flat, of = _flat(first[open_] + low, np.minimum(others[at[open_]] - low, step))
                    mine, other = own[open_][of], values[flat]
                    hit = rule(ids[at[open_]][of], *((mine, other) if kind == 0 else (other, mine))) != NONE
                    found[open_[of[hit]]] = True
                    low, step = low + step, step * 4
                    open_ = open_[~found[open_] & (others[at[open_]] > low)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(int(found.sum()), kind), pa.int32()), pa.array(own[found], pa.int32()), pa.array(ids[at[found]])], schema=schema)

    return papers.select(F.col("paper_id").cast("long").alias("paper_id"), "lefts", "rights").mapInArrow(run, "kind int, concept int, paper_id long")


def _common(n: int, sides: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, number and values of what both sides (pairs' numbers, and their values, each once) of each of ``n`` pairs have."""
    both = np.sort(np.concatenate([(of.astype(np.int64) << 32) | values.astype(np.int64) for of, values in sides]))
    both = both[1:][both[1:] == both[:-1]]
    size = np.bincount(both >> 32, minlength=n)
    return np.cumsum(size) - size, size, (both & 0xFFFFFFFF).astype(np.int32)


def share_key(rule: Rule, ids: np.ndarray, sides: list[tuple[np.ndarray, np.ndarray, np.ndarray]], a: np.ndarray, b: np.ndarray, most: int = SLICE_PAIRS) -> np.ndarray:
    """Whether the papers at places ``a`` and ``b`` have a relation of one key: among the concepts of both, until one is found.

    ``sides`` are start, number and values of the left and of the right concepts of the papers ``ids``. About ``most`` concepts, and concept pairs, are looked at at once.
    """
    out = np.zeros(len(a), bool)
    weight = sum(size[x] for _, size, _ in sides for x in (a, b))
    for chunk in np.split(np.arange(len(a)), np.flatnonzero(np.diff(np.cumsum(weight) // most)) + 1):
        ca, cb = a[chunk], b[chunk]
        met = []
        for start, size, values in sides:
            of = [_flat(start[x], size[x]) for x in (ca, cb)]
            met.append(_common(len(chunk), [(pair, values[flat]) for flat, pair in of]))
        (left_at, n_left, lefts), (right_at, n_right, rights) = met
        total = n_left * n_right
        low, open_ = np.zeros(len(chunk), np.int64), np.flatnonzero(total)
        step = 16
        while len(open_):
            flat, of = _flat(low[open_], np.minimum(total[open_] - low[open_], step))
            p = open_[of]
            left, right = lefts[left_at[p] + flat // n_right[p]], rights[right_at[p] + flat % n_right[p]]
            hit = np.flatnonzero(rule(ids[ca[p]], left, right) != NONE)
            hit = hit[rule(ids[cb[p[hit]]], left[hit], right[hit]) != NONE]
            out[chunk[p[hit]]] = True
            low[open_] += step
            open_ = open_[~out[chunk[open_]] & (total[open_] > low[open_])]
            step = max(16, min(step * 8, most // max(1, len(open_))))
    return out


#: Blocks of papers on each side of the grid in which pairs of papers meet their concepts; pairs of an endpoint that are looked at first, and at most in a round.
PAPER_BLOCKS, FIRST_LOOK, WIDEST_LOOK = 6, 8, 1 << 20


def _unshared(candidates: DataFrame, papers: DataFrame, rule: Rule) -> DataFrame:
    """``candidates`` (``kind, concept, at, paper_a, paper_b``) whose papers share no key. Papers' concepts go to the cells of blocks of papers in which a candidate asks for them."""
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(PAPER_BLOCKS)).cast("int")
    asked = candidates.withColumn("cell", block("paper_a") * PAPER_BLOCKS + block("paper_b"))
    named = asked.select("cell", F.explode(F.array("paper_a", "paper_b")).alias("paper_id")).distinct()
    told = named.join(papers.select(F.col("paper_id").cast("long").alias("paper_id"), "lefts", "rights").hint("merge"), "paper_id")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    both = told.select("cell", "paper_id", "lefts", "rights", none("int", "kind"), none("int", "concept"), none("long", "at"), none("long", "other")).unionByName(
        asked.select("cell", F.col("paper_a").alias("paper_id"), none("array<int>", "lefts"), none("array<int>", "rights"), "kind", "concept", "at", F.col("paper_b").alias("other"))
    )
    schema = pa.schema([("kind", pa.int32()), ("concept", pa.int32()), ("at", pa.int64()), ("paper_a", pa.int64()), ("paper_b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, pairs = [], []
        for batch in batches:
            is_pair = batch.column("kind").is_valid()
            known.append(batch.filter(pa.compute.invert(is_pair)).select(["paper_id", "lefts", "rights"]))
            pairs.append(batch.filter(is_pair).select(["kind", "concept", "at", "paper_id", "other"]))
        if not pairs:
            return
        known, pairs = pa.Table.from_batches(known).combine_chunks(), pa.Table.from_batches(pairs)
        if not len(pairs):
            return
        ids = known["paper_id"].to_numpy()
        order = np.argsort(ids)
        sides = []
        for name in ("lefts", "rights"):
            size, values = _lists(known[name].chunk(0))
            sides.append(((np.cumsum(size) - size)[order], size[order], values))
        ids = ids[order]
        ab = np.stack([pairs["paper_id"].to_numpy(), pairs["other"].to_numpy()])
        distinct, of = np.unique(ab, axis=1, return_inverse=True)
        shared = share_key(rule, ids, sides, *(np.searchsorted(ids, x) for x in distinct))
        kept = pairs.filter(pa.array(~shared[of.reshape(-1)])).rename_columns(schema.names).cast(schema)
        yield from kept.to_batches(1 << 16)

    return both.repartitionById(PAPER_BLOCKS**2, F.col("cell")).mapInArrow(run, "kind int, concept int, at long, paper_a long, paper_b long")


def hard_negatives(papers: DataFrame, rule: Rule, cap: int = 4) -> DataFrame:
    """``kind, concept, paper_a, paper_b``: :func:`corpora.hard_negatives` of the left concepts and of the right ones, for the relations that ``rule`` finds among the concepts of ``papers`` (written).

    No relation is dealt: an endpoint's papers are those with a relation of it, and whether two papers share a key follows from their concepts. An endpoint's pairs are numbered by
    (paper_a, paper_b), and looked at in that order, more each round, until the cap is met or the endpoint exhausted.
    """
    held = members(papers, rule).groupBy("kind", "concept").agg(F.sort_array(F.collect_list("paper_id")).alias("papers")).filter(F.size("papers") > 1)
    open_ = written(held.withColumns({"have": F.lit(0).cast("long"), "low": F.lit(0).cast("long")}))
    found, look = [], FIRST_LOOK
    n, t = F.size("papers").cast("long"), F.col("t")
    before = lambda i: (i - 1) * n - (i * (i - 1) / 2).cast("long")
    while found == [] or not open_.isEmpty():
        upto = F.least(F.col("low") + look, (n * (n - 1) / 2).cast("long"))
        numbered = open_.select("kind", "concept", "papers", F.explode(F.sequence("low", upto - 1)).alias("t"))
        # the first paper of the pair of that number: the root of a quadratic, put right where it is rounded
        root = F.floor((2 * n + 1 - F.sqrt((2 * n + 1) * (2 * n + 1) - 8 * (t + n))) / 2).cast("long")
        x = numbered.withColumn("i", F.greatest(root, F.lit(1)))
        x = x.withColumn("i", F.when(before(F.col("i")) > t, F.col("i") - 1).when(before(F.col("i") + 1) <= t, F.col("i") + 1).otherwise(F.col("i")))
        j = (F.col("i") + 1 + t - before(F.col("i"))).cast("int")
        candidates = x.select("kind", "concept", t.alias("at"), F.col("papers")[F.col("i").cast("int") - 1].alias("paper_a"), F.col("papers")[j - 1].alias("paper_b"))
        fits = F.row_number().over(Window.partitionBy("kind", "concept").orderBy("at"))
        free = _unshared(candidates, papers, rule).withColumn("_rn", fits).filter(F.col("_rn") <= cap).join(open_.select("kind", "concept", "have"), ["kind", "concept"])
        found.append(written(free.filter(F.col("_rn") + F.col("have") <= cap).select("kind", "concept", "paper_a", "paper_b")))
        more = found[-1].groupBy("kind", "concept").agg(F.count("*").alias("more"))
        now = open_.join(more, ["kind", "concept"], "left").withColumns({"have": F.col("have") + F.coalesce("more", F.lit(0)), "low": F.col("low") + look}).drop("more")
        open_ = written(now.filter((F.col("have") < cap) & (F.col("low") < (n * (n - 1) / 2).cast("long"))))
        look = min(look * 8, WIDEST_LOOK)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out
