"""SimHash near-duplicates: fingerprints of word shingles, pivot distance tables, components.

Fingerprints within a radius are found through a table of their Hamming distances to reference fingerprints. Between two
fingerprints no coordinate differs by more than their distance. Random references alone offer no equality key (README), so
the table also has zero and the pair references, which set two neighbouring bits each. Less the distance to zero, such a
coordinate depends on its two bits alone; so two fingerprints within the radius agree on the coordinates of all but ``radius``
groups of references, and pairs meet by equality of the others: no pair is lost. The greatest difference of the seeded
references' coordinates then discards pairs inside the join, and survivors are verified by their exact distance.

``near_copies`` is for a similarity of shingles. Its pairs meet by the same coordinates, so that none within the radius is lost; those
that no such radius reaches also meet by minima of shingle hashes. Fingerprints discard, and the shingles themselves decide.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Cut, encode, map_columns
from .components import components

SEED = 42
#: Seeded references of the distance table: as many as bytes in a long, which holds their coordinates.
PIVOTS = 8
#: Groups of four that the 32 pair references are dealt into.
GROUPS, IN_GROUP = 8, 4


def shingles(text: str | None, k: int) -> list[bytes]:
    """Space-joined runs of k words, repeats included; fewer words are one shingle, none give none. A-Z are lower-cased."""
    return _runs(encode(text).translate(LOWER).split(), k)


def _runs(words: list[bytes], k: int) -> list[bytes]:
    if not words:
        return []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) <= k:
        return [joined]
    starts = [0, *(ends[: len(words) - k] + 1).tolist()]
    return [joined[a:b] for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)]


#: Odd multipliers and offsets that derive further 64-bit hashes from a shingle's first one, by a fixed rule.
def _derive(h: np.ndarray, i: int) -> np.ndarray:
    if not i:
        return h
    with np.errstate(over="ignore"):
        x = h + np.uint64((0x9E3779B97F4A7C15 * i) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


#: Shingles whose bits are counted at once.
CHUNK = 1 << 14


def _hashed(parts: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in parts), np.uint64, len(parts))


def _bits(h: np.ndarray, lanes: int) -> list[int]:
    out = []
    for i in range(lanes):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(h), CHUNK):
            x = _derive(h[at : at + CHUNK], i)
            ones += np.unpackbits(x.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big"))
    return out


def fingerprint(text: str | None, k: int, lanes: int = 1) -> list[int]:
    """``lanes`` unsigned 64-bit words; a bit is 1 where more than half the hashes have it. No words: zero."""
    parts = shingles(text, k)
    return _bits(_hashed(parts), lanes) if parts else [0] * lanes


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 3, lanes: int = 1) -> DataFrame:
    """``doc_id, f0, f1, ...``: fingerprints as signed longs; null texts count as empty."""

    def run(c: dict[str, list]) -> dict[str, list]:
        prints = [fingerprint(t, k, lanes) for t in c["text"]]
        return {"doc_id": c["doc_id"]} | {f"f{i}": [_signed(p[i]) for p in prints] for i in range(lanes)}

    return map_columns(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), run, "doc_id long, " + ", ".join(f"f{i} long" for i in range(lanes)))


def references(n: int = PIVOTS, seed: int = SEED) -> list[int]:
    """The seeded references."""
    return [_signed(xxhash.xxh64_intdigest(f"reference {i}".encode(), seed)) for i in range(n)]


def pair_references() -> list[int]:
    """The references that set two neighbouring bits each, from the lowest bits on."""
    return [_signed(3 << (2 * i)) for i in range(32)]


def _distance(f: Column, reference: int) -> Column:
    return F.bit_count(f.bitwiseXOR(F.lit(reference)))


def pivot_table(distinct: DataFrame) -> DataFrame:
    """``f, d, g``: a fingerprint's distances to the seeded references, a byte each in the long ``d``, and those to the pair
    references, less the distance to zero, as a number with a digit of three values for each reference of a group."""
    f = F.col("f")
    seeded = F.lit(0).cast("long")
    for i, r in enumerate(references()):
        seeded = seeded.bitwiseOR(F.shiftleft(_distance(f, r).cast("long"), 8 * i))
    return distinct.select("f", seeded.alias("d"), pair_coordinates(f).alias("g"))


def pair_coordinates(f: Column) -> Column:
    """The coordinates ``g`` of :func:`pivot_table`."""
    zero = _distance(f, 0)
    digits = [((_distance(f, r) - zero + 2) / 2).cast("int") for r in pair_references()]
    return F.array(*[sum((digits[g * IN_GROUP + i] * 3**i for i in range(IN_GROUP)), F.lit(0)) for g in range(GROUPS)])


def meeting_keys(g: Column, radius: int) -> Column:
    """A key for each choice of all but ``radius`` groups, which spells the choice and its coordinates."""
    size = 3**IN_GROUP
    keys = []
    for j, chosen in enumerate(combinations(range(GROUPS), GROUPS - radius)):
        keys.append(sum((g[k].cast("long") * size**i for i, k in enumerate(chosen)), F.lit(j * size ** len(chosen)).cast("long")))
    return F.array(*keys)


def meetings(table: DataFrame, radius: int) -> DataFrame:
    """``key, f, d``: a row for each of the keys."""
    return table.select("f", "d", F.explode(meeting_keys(F.col("g"), radius)).alias("key"))


def greatest_difference(a: Column, b: Column) -> Column:
    """Of the seeded references' coordinates."""
    byte = lambda c, i: F.shiftright(c, 8 * i).bitwiseAND(F.lit(255))
    return F.greatest(*[F.abs(byte(a, i) - byte(b, i)) for i in range(PIVOTS)])


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """``fa, fb`` (fa < fb): all pairs of distinct fingerprints ``f`` that differ in 1 to ``radius`` bits."""
    rows = meetings(pivot_table(distinct), radius)
    a, b = rows.alias("a"), rows.alias("b")
    near = greatest_difference(F.col("a.d"), F.col("b.d")) <= radius
    exact = F.bit_count(F.col("a.f").bitwiseXOR(F.col("b.f"))) <= radius
    # by sorting: Spark takes the keys of a fingerprint, which are made in the row, for one row, and would send them all to every executor
    met = a.join(b.hint("merge"), (F.col("a.key") == F.col("b.key")) & (F.col("a.f") < F.col("b.f")) & near & exact)
    return met.select(F.col("a.f").alias("fa"), F.col("b.f").alias("fb")).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 3, radius: int = 2) -> DataFrame:
    """One row per document row: ``doc_id, fingerprint, component_id, n_links``.

    Rows of one fingerprint are a class; classes link at ``radius`` or fewer differing bits, and a component's id is the
    least document id in it. ``n_links`` counts the linked classes. Null and empty texts have fingerprint zero and
    are linked like any other. A null id gets its component's id, null if all ids there are null.
    """
    prints = Cut(fingerprints(docs, doc_id, text, k)).df.withColumnRenamed("f0", "f")
    classes = Cut(prints.groupBy("f").agg(F.min("doc_id").alias("first"))).df
    linked = Cut(links(classes.select("f"), radius)).df
    node = components(linked.select(F.col("fa").alias("a"), F.col("fb").alias("b")))
    degree = linked.select(F.col("fa").alias("f")).unionByName(linked.select(F.col("fb").alias("f"))).groupBy("f").agg(F.count("*").alias("n_links"))
    joined = classes.join(node.withColumnRenamed("node", "f"), "f", "left").join(degree, "f", "left").withColumn("component", F.coalesce("component", "f"))
    least = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    named = joined.join(least, "component").select("f", "component_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    digits = F.lower(F.lpad(F.hex("f"), 16, "0"))
    return prints.join(named, "f").select("doc_id", digits.alias("fingerprint"), "component_id", "n_links")


#: Near copies: words of a shingle, and the least similarity (shared over all distinct shingles) as a fraction.
COPY_WORDS, SIMILAR = 5, (4, 5)
#: Bands of minima and minima of a band: of pairs at a similarity of 0.8 by calculation 0.988 share a band, at any size of the corpus.
BANDS, BAND_ROWS = 24, 8
#: Fingerprint lanes, and most differing bits: at 0.8 they have 19.4 of 128, with a deviation of 4.1.
COPY_LANES, COPY_BITS = 2, 36
#: Bits of the first lane within which pairs meet by pivot coordinates, without loss.
COPY_RADIUS = 2
#: Rounds of comparing a bucket with one of its own before what is still apart is compared pair by pair.
STAR_ROUNDS = 2
#: Stands for no id where a number is needed.
NO_ID = -(2**62)


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.RandomState(SEED)
    n = BANDS * BAND_ROWS
    return (rng.randint(0, 2**31, n).astype(np.uint32) * np.uint32(2) + np.uint32(1))[:, None], rng.randint(0, 2**32, n, dtype=np.uint64).astype(np.uint32)[:, None]


_MULTIPLY, _ADD = _multipliers()


def bands(distinct: np.ndarray) -> list[int]:
    """A number for each band: a mix of the band's minima over all shingle hashes."""
    x = (distinct >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * BAND_ROWS, 2**32 - 1, np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(x), 2048):
            np.minimum(least, (_MULTIPLY * x[None, at : at + 2048] + _ADD).min(1), out=least)
        rows = least.reshape(BANDS, BAND_ROWS).astype(np.uint64)
        v = np.arange(1, BANDS + 1, dtype=np.uint64)
        for i in range(BAND_ROWS):
            v = (v ^ rows[:, i]) * np.uint64(0x9E3779B97F4A7C15)
            v ^= v >> np.uint64(29)
    return v.view(np.int64).tolist()


def _class(words: list[bytes]) -> int:
    return _signed(xxhash.xxh3_64_intdigest(b" ".join(words)))


def sketches(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id, raw, node, n, f0, f1, bands`` of every row: raw is the text's own hash, node that of its lower-cased words,
    n the number of distinct shingles."""

    def run(c: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("node", "n", "f0", "f1", "bands")}
        for t in c["text"]:
            words = encode(t).translate(LOWER).split()
            h = _hashed(_runs(words, COPY_WORDS))
            distinct = np.unique(h)
            f = _bits(h, COPY_LANES) if words else [0] * COPY_LANES
            for k, v in zip(out, (_class(words), len(distinct), *map(_signed, f), bands(distinct) if words else []), strict=True):
                out[k].append(v)
        return {"doc_id": c["doc_id"], "raw": c["raw"]} | out

    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("raw"), F.col(text).alias("text"))
    return map_columns(src, run, "doc_id long, raw long, node long, n int, f0 long, f1 long, bands array<long>")


def _shingle_sets(docs: DataFrame, doc_id: str, text: str, wanted: DataFrame) -> DataFrame:
    """``node, sh``: the distinct shingle hashes of the classes ``wanted`` (``node, first``), read from their first documents' texts."""

    def run(c: dict[str, list]) -> dict[str, list]:
        words = [encode(t).translate(LOWER).split() for t in c["text"]]
        return {"node": [_class(w) for w in words], "sh": [np.unique(_hashed(_runs(w, COPY_WORDS))).view(np.int64).tolist() for w in words]}

    src = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("first"), F.col(text).alias("text"))
    read = map_columns(src.join(wanted.select("first").distinct(), "first", "left_semi").select("text"), run, "node long, sh array<long>")
    return read.join(wanted.select("node"), "node", "left_semi").groupBy("node").agg(F.first("sh").alias("sh"))


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, raw, first_id, first_raw`` of every row: its text's hash, and the document that stands for its group.

    Groups are the components of texts that share at least ``SIMILAR`` of their distinct five-word shingles. Texts of one
    sequence of lower-cased words are one class; classes meet where the pivot coordinates of their fingerprints agree but for ``COPY_RADIUS`` groups, and
    where all minima of a band agree, so that none within that radius is lost and few beyond it; those of too unlike sizes or fingerprints are discarded, and the shingles of the others decide. In a bucket each class is first compared with one
    of the bucket's own, for ``STAR_ROUNDS`` rounds with another one each; then all pairs that still stand in
    different components, except within the component that holds most of the bucket; what each text lost and gained against a pivot
    of the bucket gives their shared shingles inside the join. So a bucket of many copies costs a line
    and no pair of a bucket that could join two groups is left out. Buckets are met by equi-joins behind partial
    aggregates, which split a bucket of any size. Null and empty texts are copies of each other. The first document has the
    group's least id (then text hash); a group without any id has its least text hash.
    """
    small = ["node", "n", "f0", "f1"]
    prints = Cut(sketches(docs, doc_id, text))
    classes = Cut(prints.df.groupBy("node").agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("first"), *[F.first(c).alias(c) for c in (*small[1:], "bands")]))
    placed = classes.df.filter("n > 0").select(*small, "bands", pair_coordinates(F.col("f0")).alias("g"))
    rows = Cut(placed.select(*small, F.explode(F.concat("bands", meeting_keys(F.col("g"), COPY_RADIUS))).alias("h")))
    met_twice = rows.df.groupBy("h").agg(F.count("*").alias("k")).filter("k > 1")
    held = Cut(rows.df.join(met_twice, "h").select("h", *small))
    rows.drop()
    wanted = classes.df.select("node", "first").join(held.df.select("node").distinct(), "node", "left_semi")
    sets = Cut(_shingle_sets(docs, doc_id, text, wanted))
    p, q = SIMILAR

    def like(a: str, b: str) -> Column:
        """Sizes that a similar pair can have, and fingerprints within the radius."""
        sizes = F.least(f"{a}.n", f"{b}.n") * q >= F.greatest(f"{a}.n", f"{b}.n") * p
        return sizes & (sum((F.bit_count(F.col(f"{a}.f{i}").bitwiseXOR(F.col(f"{b}.f{i}"))) for i in range(COPY_LANES)), F.lit(0)) <= COPY_BITS)

    def verified(met: DataFrame) -> Cut:
        pairs = met.select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")).distinct()
        one, two = sets.df.select(F.col("node").alias("a"), F.col("sh").alias("x")), sets.df.select(F.col("node").alias("b"), F.col("sh").alias("y"))
        both = F.size(F.array_intersect("x", "y"))
        return Cut(pairs.join(one, "a").join(two, "b").filter(both * (p + q) >= (F.size("x") + F.size("y")) * p).select("a", "b"))

    def grouped(found: list[Cut]) -> Cut:
        every = found[0].df
        for x in found[1:]:
            every = every.unionByName(x.df)
        return Cut(components(every))

    found: list[Cut] = []
    now = held.df.withColumn("c", F.col("node"))
    for r in range(STAR_ROUNDS):
        mark = F.xxhash64("node", F.lit(r)) if r else F.col("node")
        hub = now.groupBy("h").agg(F.min(mark).alias("mark"), F.min("c").alias("low"), F.max("c").alias("high")).filter("low <> high").select("h", "mark")
        centre = now.withColumn("mark", mark).join(hub, ["h", "mark"], "left_semi").select("h", "c", *small).dropDuplicates(["h"])
        a, b = now.alias("a"), centre.alias("b")
        found.append(verified(a.join(b, (F.col("a.h") == F.col("b.h")) & (F.col("a.c") != F.col("b.c")) & like("a", "b"))))
        group = grouped(found)
        now = held.df.join(group.df, held.df["node"] == group.df["node"], "left").select("h", *[held.df[c] for c in small], F.coalesce("component", held.df["node"]).alias("c"))
    main = now.groupBy("h", "c").agg(F.count("*").alias("k")).groupBy("h").agg(F.max_by("c", F.struct("k", "c")).alias("main"), F.count("*").alias("groups")).filter("groups > 1").select("h", "main")
    mixed = Cut(now.join(main, "h").withColumn("in_main", F.col("c") == F.col("main")))
    # one of the bucket's main component is its pivot: what two texts lost and gained against it says what they share
    pivot = Cut(mixed.df.filter("in_main").groupBy("h").agg(F.min_by("node", F.xxhash64("node")).alias("pivot")))
    held_by = mixed.df.join(pivot.df, "h").select("node", "pivot").distinct()
    one, two = sets.df.select("node", F.col("sh").alias("x")), sets.df.select(F.col("node").alias("pivot"), F.col("sh").alias("y"))
    against = held_by.join(one, "node").join(two, "pivot").select("node", "pivot", F.array_except("y", "x").alias("lost"), F.array_except("x", "y").alias("gained"), F.size("y").alias("whole"))
    profiled = Cut(mixed.df.join(pivot.df, "h").join(against, ["node", "pivot"]).drop("pivot", "main"))
    a, b = profiled.df.filter("not in_main").alias("a"), profiled.df.alias("b")
    apart = (F.col("a.c") != F.col("b.c")) & (F.col("b.in_main") | (F.col("a.node") < F.col("b.node")))
    both_lost = F.size("a.lost") + F.size("b.lost") - F.size(F.array_intersect("a.lost", "b.lost"))
    shared = F.col("a.whole") - both_lost + F.size(F.array_intersect("a.gained", "b.gained"))
    similar = shared * (p + q) >= (F.col("a.n") + F.col("b.n")) * p
    met = a.join(b, (F.col("a.h") == F.col("b.h")) & apart & like("a", "b") & similar)
    found.append(Cut(met.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()))
    group = grouped(found)
    for x in (held, sets, mixed, pivot, profiled, *found):
        x.drop()
    node = classes.df.select(F.col("node").alias("own")).join(group.df, F.col("own") == group.df["node"], "left").select(F.col("own").alias("node"), F.coalesce("component", "own").alias("c"))
    # by class first, then by group: rows of a class of any size meet its name in a plain join
    of_class = Cut(prints.df.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "raw")).alias("least")).join(node, "node"))
    first = of_class.df.groupBy("c").agg(F.min("least").alias("first"))
    named = Cut(of_class.df.join(first, "c").select("node", F.col("first.doc_id").alias("first_id"), F.col("first.raw").alias("first_raw")))
    of_class.drop()
    return prints.df.join(named.df, "node").select("doc_id", "raw", "first_id", "first_raw")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs`` that are their group's first document. Rows of one id and one text stay or go together; a row
    without an id goes where its group has one with an id."""
    names = {c: f"_{i}" for i, c in enumerate(docs.columns)}
    gone = near_copies(docs, doc_id, text).filter(~(F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("raw") == F.col("first_raw")))).select(F.col("doc_id").alias("gone_id"), F.col("raw").alias("gone_raw")).distinct()
    mine = docs.select(*[F.col(c).alias(v) for c, v in names.items()])
    same = F.col(names[doc_id]).cast("long").eqNullSafe(F.col("gone_id")) & (F.xxhash64(F.col(names[text])) == F.col("gone_raw"))
    return mine.join(gone, same, "left_anti").select(*[F.col(v).alias(c) for c, v in names.items()])
