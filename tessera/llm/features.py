"""Features of a shop's sales as they were known at a time of each sale: point in time, late arrivals left out.

Every event has a time and an availability, the later of its time and its arrival with the delay. A probe at t with a
window of d days asks for events later than t - d that are available at t. Per client the events stand in order of time, and a
merge-sort tree lies over their places: dyadic blocks, each sorted by availability, with prefix sums and the
prefix maximum of clicks. A probe's window is a range of places; it is taken apart into blocks, and a binary search by t in each
gives its sums.

The tree is dealt over tasks by places, never by client. Up to ``PIECE`` consecutive places a block lives inside one task,
as numpy arrays. Blocks above, which only clients with more events in a window have, are tables: Spark sorts their rows by
block and availability, running sums go along each sorted run, and what earlier runs of a block hold is carried over in one
row a run. So no task holds all rows of a client, an item or a block, and nothing that grows goes through the driver.

Distinct items: a line counts until a later line of the same client and item is available, which stands as a row of -1
at the same place. So sums suffice.

Defined results: rows without client, time or arrival are no events (such a sale still makes ``label`` true, if it has client and time);
fully equal clicks count once; repeated sales count each, each with its lines; a null sale_id has no lines, and its time is
that of an empty id; sales repeated in all used columns give equal rows; a null amount counts 0. Columns not named here count only
for the equality of clicks. Tables may be empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut
from .ordered import spread

DAY = 86_400_000_000
#: Days of the windows, minutes until an arrived event can be used, days of the label.
WINDOWS, DELAY_MINUTES, LABEL_DAYS = (2, 14), 240, 7
#: The greatest shift of a sale's time, in seconds.
SHIFT_SECONDS = 259_200
#: Places of a piece: the largest block that lives in one task.
PIECE_BITS = 12
PIECE = 1 << PIECE_BITS
#: Lookups that meet one copy of a piece.
LOOKUPS = 16_384
#: No event is available at this time.
NEVER = 1 << 62

#: What a row of the tree is, and what it adds to the sums below.
CLICK, PURCHASE, SALE, LINE, ITEM_LINE, ITEM_AGAIN, UNKNOWN_SALE = range(1, 8)
SUMS = ("n_clicks", "n_purchases", "click_cents", "n_sales", "sale_cents", "n_lines", "n_items", "line_cents")
COUNTS = {"n_clicks": (CLICK, PURCHASE), "n_purchases": (PURCHASE,), "n_sales": (SALE,), "n_lines": (LINE, ITEM_LINE), "n_items": (ITEM_LINE,)}
CENTS = {"click_cents": (CLICK, PURCHASE), "sale_cents": (SALE,), "line_cents": (LINE, ITEM_LINE)}



def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in ddl.split(","))])


PROBE = "sale_id long, client long, t long"
EVENT = "client long, ts long, s long, kind int, cents long, id long"


def micros(df: DataFrame, name: str) -> Column:
    """Epoch microseconds of a time that is UTC, with a zone or without, whatever the session's zone."""
    c = F.col(name)
    if isinstance(df.schema[name].dataType, T.TimestampNTZType):
        parts = (F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86_400 + F.hour(c) * 3600 + F.minute(c) * 60) * 1_000_000
        return parts + (F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("long")
    return F.unix_micros(c)


def cents(name: str) -> Column:
    return F.coalesce(F.floor(F.lit(100) * F.col(name) + 0.5).cast("long"), F.lit(0))


def _unlike(df: DataFrame) -> DataFrame:
    """Fully equal rows once. Long and nested values are compared by digest, so that they don't travel."""

    def short(f: T.StructField) -> Column:
        if isinstance(f.dataType, T.StringType):
            return F.unhex(F.md5(F.col(f"`{f.name}`")))
        if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType, T.VariantType)):
            return F.unhex(F.md5(F.to_json(F.struct(F.col(f"`{f.name}`")))))
        return F.col(f"`{f.name}`")

    used = ("click_id", "client_id", "kind", "value", "ts", "arrived_at")
    rest = [short(f).alias(f"_x{i}") for i, f in enumerate(df.schema) if f.name not in used]
    return df.select(*used, *rest).distinct()


def _batches(fn, state):
    """``fn(columns, state)`` over the batches of a partition, in order, and ``fn(None, state)`` at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = state()
        for batch in batches:
            if batch.num_rows:
                yield fn(batch, held)
        last = fn(None, held)
        if last is not None:
            yield last

    return run


def _numbers(batch: pa.RecordBatch, name: str, null: int = 0) -> np.ndarray:
    col = batch.column(batch.schema.get_field_index(name))
    return col.fill_null(null).to_numpy(zero_copy_only=False)


def _changes(*keys: np.ndarray) -> np.ndarray:
    """True where a row's key is not that of the row before."""
    new = np.zeros(len(keys[0]), bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _carried(runs: DataFrame, first: list[str], last: list[str], add: dict[str, Column]) -> DataFrame:
    """One row a run (``run``, its first and last key, what the rows of its last key sum up to) -> for each run whose first key began earlier, what it had there."""
    own = Window.partitionBy(*last).orderBy("run").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    order = Window.orderBy("run")  # as many rows as there are partitions
    sums = runs.select("run", *first, *last, *(f(c).over(own).alias(c) for c, f in add.items()))
    before = sums.select("run", *first, *(F.lag(c).over(order).alias(c) for c in (*last, *add)))
    same = F.lit(True)
    for a, b in zip(first, last, strict=True):
        same = same & (F.col(a) == F.col(b))
    return before.filter(same).select(F.col("run").alias("_run"), *(F.col(c).alias(f"_{c}") for c in add))


# --- lines, and when a later line of the item is available


SOLD_LINE = "client long, item long, ts long, s long, cents long"


def _next_min(batch: pa.RecordBatch | None, held: dict) -> pa.RecordBatch | None:
    """Rows sorted by (client, item, time downwards): the least availability of the rows before in the same (client, item), in this run."""
    schema = _arrow(SOLD_LINE + ", later long, head boolean, run int, first_client long, first_item long, tail long")
    run = TaskContext.get().partitionId()
    if batch is None:
        if not held:
            return None
        row = [held["client"], held["item"], None, None, None, None, None, run, held["first"][0], held["first"][1], held["min"]]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)
    client, item, s = (_numbers(batch, c) for c in ("client", "item", "s"))
    new = _changes(client, item)
    group = np.cumsum(new)
    least = pd.Series(s).groupby(group).cummin().to_numpy()
    later = np.full(len(s), NEVER)
    later[1:] = np.where(new[1:], NEVER, least[:-1])
    head = np.zeros(len(s), bool)
    if not held:
        held["first"], held["in_head"] = (client[0], item[0]), True
    elif (held["client"], held["item"]) == (client[0], item[0]):
        first = group == 0
        later[first] = np.minimum(later[first], held["min"])
        least[first] = np.minimum(least[first], held["min"])
    else:
        held["in_head"] = False
    if held["in_head"]:
        head = group == 0
        held["in_head"] = group[-1] == 0
    held.update(client=client[-1], item=item[-1], min=least[-1])
    n = len(s)
    extra = [pa.array(later), pa.array(head), *(pa.nulls(n, f.type) for f in list(schema)[7:])]
    return pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in ("client", "item", "ts", "s", "cents")), *extra], schema=schema)


def _line_events(lines: DataFrame, sales: DataFrame, keep_us: int) -> DataFrame:
    """Events of the lines of ``sales`` (sale_id, client, ts, s), and the rows that take an item's earlier line back."""
    shipped = lines.filter("sale_id is not null and shipped_at is not null").select("sale_id", F.col("item_id").alias("item"), micros(lines, "shipped_at").alias("shipped"), cents("amount").alias("cents"), "line_no")
    # a hot sale's lines are one key of this join: adaptive execution splits them, the sales are one row a key
    met = shipped.join(sales, "sale_id").select("client", "item", "ts", F.greatest("s", "shipped").alias("s"), "cents", F.xxhash64("sale_id", "line_no", "cents").alias("tie"))
    sold = cut(met)
    plain = sold.filter("item is null").select("client", "ts", "s", F.lit(LINE).alias("kind"), "cents", F.lit(None).cast("long").alias("id"))
    known = sold.filter("item is not null")
    by = [F.col(c).asc() for c in ("client", "item")] + [F.col(c).desc() for c in ("ts", "s", "tie")]
    schema = SOLD_LINE + ", later long, head boolean, run int, first_client long, first_item long, tail long"
    seen = cut(known.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_batches(_next_min, dict), schema).withColumn("_at", F.spark_partition_id()))
    runs = seen.filter("run is not null").select("run", F.col("first_client"), F.col("first_item"), "client", "item", "tail")
    carry = _carried(runs, ["first_client", "first_item"], ["client", "item"], {"tail": F.min})
    rows = seen.filter("run is null")
    # one row a partition at most
    whole = rows.join(F.broadcast(carry), (F.col("_at") == F.col("_run")) & F.col("head"), "left").withColumn("later", F.least("later", F.coalesce("_tail", F.lit(NEVER))))
    items = whole.select("client", "ts", "s", F.lit(ITEM_LINE).alias("kind"), "cents", F.lit(None).cast("long").alias("id"))
    gone = F.greatest("s", "later")
    again = whole.filter(gone < F.col("ts") + keep_us).select("client", "ts", gone.alias("s"), F.lit(ITEM_AGAIN).alias("kind"), F.lit(0).cast("long").alias("cents"), F.lit(None).cast("long").alias("id"))
    return plain.unionByName(items).unionByName(again)


# --- places


def _places(batch: pa.RecordBatch | None, held: dict) -> pa.RecordBatch | None:
    """Each row's number of events, and of sales, up to it (an event: before it), in this run."""
    if batch is None:
        return None
    kind = _numbers(batch, "kind")
    event = (kind > 0) & (kind != UNKNOWN_SALE)
    sale = (kind == SALE) | (kind == UNKNOWN_SALE)
    places, sales = np.cumsum(event) + held.get("places", 0), np.cumsum(sale) + held.get("sales", 0)
    held["places"], held["sales"] = places[-1], sales[-1]
    run = np.full(len(kind), TaskContext.get().partitionId(), np.int32)
    more = {"place": pa.array(places - event), "sales": pa.array(sales), "run": pa.array(run)}
    return pa.RecordBatch.from_arrays([*batch.columns, *more.values()], names=[*batch.schema.names, *more])


def _marks(sales: DataFrame) -> DataFrame:
    """Where each sale's windows begin and end: rows that stand behind all events of their time; kind says which."""
    at = [(0, 0), *((-i, -d * DAY) for i, d in enumerate(WINDOWS, 1)), (-len(WINDOWS) - 1, LABEL_DAYS * DAY)]
    marks = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), (F.col("t") + shift).alias("ts")) for k, shift in at)))
    return sales.select("client", "sale_id", "t", marks.alias("m")).select("client", "m.ts", F.lit(None).cast("long").alias("s"), "m.kind", F.col("t").alias("cents"), F.col("sale_id").alias("id"))


# --- taking windows apart


def _blocks(lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """Rows, level and block of the dyadic blocks that fill [lo, hi)."""
    lo, hi, level, row = lo.copy(), hi.copy(), 0, np.arange(len(lo))
    while len(row):
        odd = (lo & 1).astype(bool) & (lo < hi)
        yield row[odd], level, lo[odd]
        lo = lo + odd
        odd = (hi & 1).astype(bool) & (lo < hi)
        yield row[odd], level, hi[odd] - 1
        hi = hi - odd
        lo, hi, level = lo >> 1, hi >> 1, level + 1
        left = lo < hi
        lo, hi, row = lo[left], hi[left], row[left]


LOOKUP = PROBE + ", d int, level int, block long, lo int, hi int"


def _lookups(bits: int):
    """Windows [lo, hi) of places -> ranges in pieces of 2 ** ``bits`` places (level -1), and whole blocks of pieces between them."""
    schema, piece = _arrow(LOOKUP), 1 << bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield taken(batch)

    def taken(batch: pa.RecordBatch) -> pa.RecordBatch:
        lo, hi = _numbers(batch, "lo"), _numbers(batch, "hi")
        a, b = lo >> bits, (hi - 1) >> bits
        some, split = lo < hi, (lo < hi) & (a < b)
        at = lambda m: np.flatnonzero(m)
        low = lambda x: (x & (piece - 1))
        parts = [(at(some), -1, a[some], low(lo[some]), np.where(split[some], piece, low(hi[some] - 1) + 1)), (at(split), -1, b[split], np.zeros(split.sum(), np.int64), low(hi[split] - 1) + 1)]
        for row, level, block in _blocks(a[split] + 1, b[split]):
            parts.append((at(split)[row], level, block, np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)))
        row = np.concatenate([p[0] for p in parts])
        cols = [batch.column(batch.schema.get_field_index(c)).take(pa.array(row)) for c in ("sale_id", "client", "t", "d")]
        cols.append(pa.array(np.concatenate([np.full(len(p[0]), p[1], np.int32) for p in parts])))
        cols += [pa.array(np.concatenate([p[i] for p in parts]).astype(kind)) for i, kind in ((2, np.int64), (3, np.int32), (4, np.int32))]
        return pa.RecordBatch.from_arrays(cols, schema=schema)

    return run


# --- blocks inside a piece


FOUND = PROBE + ", d int, " + ", ".join(f"{c} long" for c in SUMS) + ", last_place long, last_id long"


def _amounts(kind: np.ndarray, cents: np.ndarray) -> np.ndarray:
    out = np.zeros((len(kind), len(SUMS)), np.int64)
    for i, name in enumerate(SUMS):
        if name in COUNTS:
            out[:, i] = np.isin(kind, COUNTS[name])
        else:
            out[:, i] = np.where(np.isin(kind, CENTS[name]), cents, 0)
    out[:, SUMS.index("n_items")] -= kind == ITEM_AGAIN
    return out


class Tree:
    """The merge-sort tree over a piece: on each level, blocks of 2 ** level places sorted by availability, with prefix sums and prefix maxima of clicks."""

    def __init__(self, s: np.ndarray, amounts: np.ndarray, click: np.ndarray):
        self.n, self.amounts = len(s), amounts
        self.by_s = np.argsort(s, kind="stable")
        self.sorted = s[self.by_s]
        self.rank = np.empty(self.n, np.int64)
        self.rank[self.by_s] = np.arange(self.n)
        self.click = np.where(click, np.arange(self.n) + 1, 0)
        self.levels: dict[int, tuple] = {}

    def level(self, k: int) -> tuple:
        if k not in self.levels:
            key = (np.arange(self.n) >> k << PIECE_BITS) | self.rank
            order = np.argsort(key)
            block = np.arange(self.n) >> k << (PIECE_BITS + 1)  # blocks keep their places when sorted inside
            sums = np.concatenate([np.zeros((1, self.amounts.shape[1]), np.int64), np.cumsum(self.amounts[order], axis=0)])
            last = np.maximum.accumulate(block | self.click[order]) & (2 * PIECE - 1)
            self.levels[k] = key[order], sums, last
        return self.levels[k]

    def search(self, lo: np.ndarray, hi: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums over the places [lo, hi) that are available at t, and the last click among them (place + 1, or 0)."""
        out, last = np.zeros((len(lo), self.amounts.shape[1]), np.int64), np.zeros(len(lo), np.int64)
        known = np.searchsorted(self.sorted, t, side="right")
        for row, k, block in _blocks(lo, hi):
            if len(row):
                keys, sums, most = self.level(k)
                begin, end = np.minimum(block << k, self.n), np.searchsorted(keys, (block << PIECE_BITS) + known[row])
                end = np.maximum(end, begin)
                np.add.at(out, row, sums[end] - sums[begin])
                some = end > begin
                last[row[some]] = np.maximum(last[row[some]], most[end[some] - 1])
        return out, last


def _found(schema: pa.Schema, probes: list, sums: np.ndarray, last: pa.Array, last_id: pa.Array) -> pa.Table:
    return pa.Table.from_arrays([*probes, *(pa.array(sums[:, i]) for i in range(len(SUMS))), last, last_id], schema=schema)


def _search_piece(events: pa.Table, lookups: pa.Table) -> pa.Table:
    schema = _arrow(FOUND)
    probes = [lookups.column(c).combine_chunks() for c in ("sale_id", "client", "t", "d")]
    place = events.column("place").to_numpy()
    order = np.argsort(place)
    kind, cents, s = (events.column(c).to_numpy()[order] for c in ("kind", "cents", "s"))
    tree = Tree(s, _amounts(kind, cents), np.isin(kind, (CLICK, PURCHASE)))
    lo, hi, t = (lookups.column(c).to_numpy().astype(np.int64) for c in ("lo", "hi", "t"))
    sums, last = tree.search(lo, np.minimum(hi, tree.n), t)
    base = place[order[0]] if len(order) else 0
    ids = events.column("id").combine_chunks().take(pa.array(order))
    none = pa.array(last == 0)
    at = pa.array(np.maximum(last - 1, 0), mask=last == 0)
    places = pc.if_else(none, pa.scalar(None, pa.int64()), pa.array(last - 1 + base))
    return _found(schema, probes, sums, places, ids.take(at))


# --- blocks above a piece


RUNNING = "level int, block long, " + FOUND + ", head boolean, run int, first_level int, first_block long"


def _search_runs(batch: pa.RecordBatch | None, held: dict) -> pa.RecordBatch | None:
    """Rows sorted by (level, block, availability or t, events first): for each probe, the sums of its block's rows before it in this run."""
    schema = _arrow(RUNNING)
    if batch is None:
        if not held:
            return None
        last = None if held["last"] < 0 else int(held["last"])
        row = [held["level"], held["block"], None, None, None, None, *held["sums"], last, held["id"], None, TaskContext.get().partitionId(), *held["first"]]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)
    level, block, kind, cents, place = (_numbers(batch, c) for c in ("level", "block", "kind", "cents", "place"))
    ids = batch.column(batch.schema.get_field_index("id"))
    new = _changes(level, block)
    begin = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    sums = np.concatenate([np.zeros((1, len(SUMS)), np.int64), np.cumsum(_amounts(kind, cents), axis=0)])
    sums = sums[1:] - sums[begin]
    click = np.isin(kind, (CLICK, PURCHASE))
    group = np.cumsum(new)
    last = pd.Series(np.where(click, place, -1)).groupby(group).cummax().to_numpy()
    same = bool(held) and (held["level"], held["block"]) == (level[0], block[0])
    if same:
        first = group == 0
        sums[first] += np.array(held["sums"])
        last[first] = np.maximum(last[first], held["last"])
    spots = np.flatnonzero(click)[np.argsort(place[click])]  # where the batch holds a click of a given place
    old = held.get("last", -1), held.get("id")

    def ids_of(places: np.ndarray) -> pa.Array:
        at = np.searchsorted(place[spots], places)
        here = (at < len(spots)) & (places >= 0)
        here[here] = place[spots[at[here]]] == places[here]
        found = ids.take(pa.array(spots[np.minimum(at, max(len(spots) - 1, 0))] if len(spots) else np.zeros(len(places), int), mask=~here))
        return pc.if_else(pa.array((places >= 0) & (places == old[0]) & ~here), pa.scalar(old[1], pa.int64()), found)

    if not held:
        held["first"], held["in_head"] = (level[0], block[0]), True
    elif not same:
        held["in_head"] = False
    head = (group == 0) & held["in_head"]
    held["in_head"] = held["in_head"] and group[-1] == 0
    held.update(level=level[-1], block=block[-1], sums=[int(x) for x in sums[-1]], last=int(last[-1]), id=ids_of(last[-1:])[0].as_py())
    row = np.flatnonzero(kind == 0)
    take = lambda c: batch.column(batch.schema.get_field_index(c)).take(pa.array(row))
    out = [take("level"), take("block"), *(take(c) for c in ("sale_id", "client", "t", "d")), *(pa.array(sums[row, i]) for i in range(len(SUMS)))]
    out += [pa.array(last[row], mask=last[row] < 0), ids_of(last[row]), pa.array(head[row])]
    out += [pa.nulls(len(row), f.type) for f in list(schema)[-3:]]
    return pa.RecordBatch.from_arrays(out, schema=schema)


def _search_above(events: DataFrame, lookups: DataFrame) -> DataFrame:
    """Lookups of whole blocks of pieces."""
    wanted = lookups.select("level", "block").distinct()
    pieces = wanted.select("level", "block", F.explode(F.sequence(F.expr("shiftleft(block, level)"), F.expr("shiftleft(block + 1, level) - 1"))).alias("piece"))
    rows = events.join(pieces, "piece").select("level", "block", F.col("s").alias("at"), "kind", "cents", "place", "id")
    none = {c: F.lit(None).cast(k) for c, k in (("sale_id", "long"), ("client", "long"), ("t", "long"), ("d", "int"))}
    probes = lookups.select("level", "block", F.col("t").alias("at"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("cents"), F.lit(-1).cast("long").alias("place"), F.lit(None).cast("long").alias("id"), *none)
    both = cut(rows.withColumns(none).unionByName(probes))
    ordered = spread(both, "level", "block", "at", (F.col("kind") == 0), "place", "sale_id", "d")
    seen = cut(ordered.mapInArrow(_batches(_search_runs, dict), RUNNING).withColumn("_at", F.spark_partition_id()))
    runs = seen.filter("run is not null").select("run", "first_level", "first_block", "level", "block", *SUMS, F.struct("last_place", "last_id").alias("last"))
    carry = _carried(runs, ["first_level", "first_block"], ["level", "block"], {**dict.fromkeys(SUMS, F.sum), "last": F.max})
    met = seen.filter("run is null").join(F.broadcast(carry), (F.col("_at") == F.col("_run")) & F.col("head"), "left")
    last = F.greatest(F.struct("last_place", "last_id"), F.coalesce("_last", F.struct(F.lit(None).cast("long").alias("last_place"), F.lit(None).cast("long").alias("last_id"))))
    return met.select("sale_id", "client", "t", "d", *((F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in SUMS), last.alias("_l")).select("sale_id", "client", "t", "d", *SUMS, "_l.last_place", "_l.last_id")


def _search_pieces(events: DataFrame, lookups: DataFrame) -> DataFrame:
    """Lookups inside pieces. Many lookups of one piece are dealt over copies of it, each for ``LOOKUPS`` of them."""
    copies = lookups.groupBy(F.col("block").alias("piece")).agg(F.ceil(F.count("*") / LOOKUPS).cast("int").alias("copies"))
    dealt = events.join(copies, "piece").select("piece", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), "place", "s", "kind", "cents", "id")
    asked = lookups.withColumnRenamed("block", "piece").join(copies, "piece").withColumn("copy", F.pmod(F.xxhash64("sale_id", "t", "d"), F.col("copies")).cast("int")).drop("copies", "level")
    return dealt.groupBy("piece", "copy").cogroup(asked.groupBy("piece", "copy")).applyInArrow(_search_piece, FOUND)


def point_in_time(clicks: DataFrame, sales: DataFrame, lines: DataFrame, piece_bits: int = PIECE_BITS) -> DataFrame:
    """``sale_id, d, t_us, label`` and the sums of ``SUMS`` and ``last_click_id``, a row for each sale with client and time, and window.

    A task holds blocks of up to 2 ** ``piece_bits`` places, ``PIECE`` at most; fewer only move work to the tables.
    """
    delay = DELAY_MINUTES * 60_000_000
    none = F.lit(None).cast("long")
    seen = _unlike(clicks).filter("client_id is not null and ts is not null and arrived_at is not null")
    clicked = seen.select(F.col("client_id").alias("client"), micros(clicks, "ts").alias("ts"), (micros(clicks, "arrived_at") + delay).alias("s"), F.when(F.col("kind") == "purchase", PURCHASE).otherwise(CLICK).alias("kind"), cents("value").alias("cents"), F.col("click_id").alias("id"))
    clicked = clicked.withColumn("s", F.greatest("ts", "s"))
    shift = F.crc32(F.coalesce(F.col("sale_id").cast("string"), F.lit("")).cast("binary")) % SHIFT_SECONDS * 1_000_000
    known = sales.filter("client_id is not null and sold_at is not null").select("sale_id", F.col("client_id").alias("client"), micros(sales, "sold_at").alias("ts"), (micros(sales, "arrived_at") + delay).alias("s"), cents("total").alias("cents"))
    known = known.withColumn("s", F.when(F.col("s").isNotNull(), F.greatest("ts", "s")))
    sold = known.select("client", "ts", F.coalesce("s", F.lit(NEVER)).alias("s"), F.when(F.col("s").isNull(), UNKNOWN_SALE).otherwise(SALE).alias("kind"), "cents", none.alias("id"))
    lined = _line_events(lines, known.filter("s is not null and sale_id is not null").select("sale_id", "client", "ts", "s"), max(WINDOWS) * DAY)
    marks = _marks(known.withColumn("t", F.col("ts") + shift))
    rows = clicked.unionByName(sold).unionByName(lined).unionByName(marks)
    order = spread(rows, "client", "ts", F.col("kind") <= 0, F.when(F.col("kind") <= PURCHASE, F.col("id")), "s", "kind", F.xxhash64("cents", "id"))
    placed = cut(order.mapInArrow(_batches(_places, dict), EVENT + ", place long, sales long, run int"))
    runs = placed.groupBy("run").agg(F.max(F.col("place") + ((F.col("kind") > 0) & (F.col("kind") != UNKNOWN_SALE)).cast("int")).alias("p"), F.max("sales").alias("q"))
    before = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as there are partitions
    runs = runs.select(F.col("run").alias("_run"), *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}") for c in "pq"))
    placed = placed.join(F.broadcast(runs), F.col("run") == F.col("_run")).withColumns({"place": F.col("place") + F.col("_p"), "sales": F.col("sales") + F.col("_q")})
    events = placed.filter((F.col("kind") > 0) & (F.col("kind") != UNKNOWN_SALE)).select(F.expr(f"shiftright(place, {piece_bits})").alias("piece"), "place", "s", "kind", "cents", "id")
    of = lambda k, c: F.max(F.when(F.col("kind") == k, F.col(c)))
    ends = placed.filter("kind <= 0").groupBy(F.col("id").alias("sale_id"), "client", F.col("cents").alias("t")).agg(
        of(0, "place").alias("hi"), *(of(-i, "place").alias(f"lo{d}") for i, d in enumerate(WINDOWS, 1)), (of(-len(WINDOWS) - 1, "sales") > of(0, "sales")).alias("label"), F.count(F.when(F.col("kind") == 0, 1)).alias("copies")
    )
    probes = cut(ends.select("sale_id", "client", "t", "hi", "label", "copies", F.explode(F.array(*(F.struct(F.lit(d).alias("d"), F.col(f"lo{d}").alias("lo")) for d in WINDOWS))).alias("w")).select("*", "w.*").drop("w"))
    lookups = cut(probes.select("sale_id", "client", "t", "d", "lo", "hi").mapInArrow(_lookups(piece_bits), LOOKUP))
    found = _search_pieces(events, lookups.filter("level < 0")).unionByName(_search_above(events, lookups.filter("level >= 0")))
    nothing = probes.select("sale_id", "client", "t", "d", *(F.lit(0).cast("long").alias(c) for c in SUMS), none.alias("last_place"), none.alias("last_id"), "label", "copies")
    total = found.withColumns({"label": F.lit(None).cast("boolean"), "copies": none}).unionByName(nothing).groupBy("sale_id", "client", "t", "d").agg(
        *(F.sum(c).alias(c) for c in SUMS), F.max(F.when(F.col("last_place").isNotNull(), F.struct("last_place", "last_id"))).alias("last"), F.max("label").alias("label"), F.max("copies").alias("copies")
    )
    shown = ("n_clicks", "n_purchases", "click_cents", F.col("last.last_id").alias("last_click_id"), "n_sales", "sale_cents", "n_lines", "n_items", "line_cents")
    return total.select("sale_id", "d", F.col("t").alias("t_us"), F.coalesce("label", F.lit(False)).alias("label"), *shown, F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("_c")).drop("_c")
