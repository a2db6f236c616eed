"""Blocks of token ids, coded by an adaptive range coder that mixes id predictions of order 0 to 2.

A block is coded on its own: its model starts anew, its header carries count and checksum, so that any block can be read,
and checked, without the others. Model of the next id, given the two before it:

* order 2 and order 1 predict the id that last followed this context, with a confidence of 0 to 3;
* order 0 has adaptive frequencies of the block's ids, summed up anew at growing distances;
* the mixing weights of the three adapt with every id, kept apart by the two confidences. The first order that is right codes the id.

Blocks don't depend on each other, so a batch of them goes in step, one id of every block at a time, as numpy vectors.

Layout, little-endian: ``TI1``, ids (u32), crc32 of the ids as u32 (u32), distinct ids (u32), these ids ascending as LEB128 gaps,
then the coder's 32-bit words.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

MAGIC = b"TI1"
#: Ids of a block, at most the places of order 0, and blocks that go in step.
BLOCK, LANES = 4096, 1536
#: Both the weights and the frequencies of order 0 sum up to 2 ** BITS.
BITS = 12
WHOLE = 1 << BITS
#: Slots of a block's order-2 table, and the greatest confidence.
SLOTS, SURE = 2048, 3
#: The speed at which weights follow, and the least weight.
RATE, LEAST = 5, 24
#: What an id adds to its order-0 frequency.
STEP = 32
#: Ids after which the frequencies are summed up.
RENEW = frozenset((0, 16, 48, 112, 240, 496, 1008, 2032, 3056))
#: The interval is below 2 ** 62; 32 bits go when it is shorter than 2 ** 30.
WIDE, SHORT = 62, 30


class BadBlock(ValueError):
    """A block that isn't whole: another format, cut off, or other ids than its checksum says."""


class Model:
    """What all blocks of a batch have seen so far; blocks (lanes) stand by falling length, so that the first ``n`` are those still open."""

    def __init__(self, sizes: np.ndarray, reads: bool):
        self.lanes, self.wide, self.reads = len(sizes), int(sizes.max(initial=1)), reads
        lane = np.arange(self.lanes)
        self.own1, self.own2, self.own_mix, self.own_slot = lane * self.wide, lane * SLOTS, lane * (SURE + 1) ** 2, lane * WHOLE
        # an id and a confidence: id * 4 + confidence
        self.guess1, self.guess2 = np.zeros(self.lanes * self.wide, np.int16), np.zeros(self.lanes * SLOTS, np.int16)
        # weights of order 2 and 1: w2 * 2 ** 16 + w1
        self.weights = np.full(self.lanes * (SURE + 1) ** 2, (WHOLE >> 3 << 16) + (WHOLE >> 3), np.int32)
        self.counts = (np.arange(self.wide)[None, :] < sizes[:, None]).astype(np.int32)
        self.flat_counts, self.used = self.counts.ravel(), self.counts.copy()
        self.free = (WHOLE - sizes)[:, None]
        self.before, self.before2 = np.zeros(self.lanes, np.int64), np.zeros(self.lanes, np.int64)

    def _renew(self) -> None:
        """Order 0's frequencies and their running sums (sum * 2 ** 16 + frequency), and which id stands at each place."""
        share = self.used + self.counts * self.free // np.maximum(self.counts.sum(axis=1, keepdims=True), 1)
        share[np.arange(self.lanes), self.counts.argmax(axis=1)] += WHOLE - share.sum(axis=1)
        self.spans = (((np.cumsum(share, axis=1) - share) << 16) + share).ravel()
        if self.reads:
            self.places = np.repeat(np.tile(np.arange(self.wide, dtype=np.int16), self.lanes), share.ravel())

    def begin(self, step: int, n: int) -> None:
        """Predictions for the next id of the first ``n`` lanes, and the weights."""
        if step in RENEW:
            self._renew()
        p1 = self.before[:n]
        self.at1 = self.own1[:n] + p1
        self.at2 = self.own2[:n] + ((self.before2[:n] * 40_503 + p1 * 7919) & (SLOTS - 1))
        e1, e2 = self.guess1[self.at1], self.guess2[self.at2]
        self.c1, self.c2 = e1 & 3, e2 & 3
        self.id1, self.id2 = e1 >> 2, e2 >> 2
        self.row = self.own_mix[:n] + ((self.c2 << 2) | self.c1)
        w = self.weights[self.row]
        self.w2, self.w1 = w >> 16, w & 0xFFFF

    def learn(self, ids: np.ndarray, order: np.ndarray, n: int) -> None:
        """The ids that came, and which prediction (0: order 2, 1: order 1, 2: order 0) has coded each."""
        room = WHOLE - 3 * LEAST
        w2 = self.w2 + (((order == 0) * room - self.w2 + LEAST) >> RATE)
        w1 = self.w1 + (((order == 1) * room - self.w1 + LEAST) >> RATE)
        self.weights[self.row] = (np.maximum(w2, LEAST) << 16) + np.maximum(w1, LEAST)
        four = ids << 2
        self.guess1[self.at1] = four + (self.id1 == ids) * np.minimum(self.c1 + 1, SURE)
        self.guess2[self.at2] = four + (self.id2 == ids) * np.minimum(self.c2 + 1, SURE)
        self.flat_counts[self.own1[:n] + ids] += STEP
        self.before2[:n] = self.before[:n]
        self.before[:n] = ids


def _gaps(ids: np.ndarray) -> bytes:
    """Ascending ids as LEB128 gaps."""
    gap = np.diff(ids, prepend=0)
    parts = np.stack([gap >> 7 * i & 127 for i in range(5)], axis=1)
    more = np.stack([gap >> 7 * (i + 1) > 0 for i in range(5)], axis=1)
    kept = np.concatenate([np.ones((len(gap), 1), bool), more[:, :-1]], axis=1)
    return (parts | more << 7)[kept].astype(np.uint8).tobytes()


def _from_gaps(data: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    """``n`` ids, and where they end."""
    raw = np.frombuffer(data, np.uint8, min(len(data) - at, 5 * n), at)
    ends = np.flatnonzero(raw < 128)[:n]
    if len(ends) < n:
        raise BadBlock("cut off")
    if not n:
        return np.zeros(0, np.int64), at
    raw = raw[: ends[-1] + 1].astype(np.int64)
    begin = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(begin, ends - begin + 1)
    return np.cumsum(np.add.reduceat((raw & 127) << 7 * np.minimum(place, 8), begin)), at + int(ends[-1]) + 1


def _named(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids, ascending, and each id's rank among them."""
    if not len(ids) or ids.max() >= 1 << 18:
        return np.unique(ids, return_inverse=True)
    there = np.zeros(int(ids.max()) + 1, bool)
    there[ids] = True
    return np.flatnonzero(there), (np.cumsum(there) - 1)[ids]


def crc_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """Each block of ids as bytes; an empty block has a header only."""
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    out: list[bytes] = [b""] * len(blocks)
    for at in range(0, len(order), LANES):
        part = order[at : at + LANES]
        for i, data in zip(part, _encode([np.asarray(blocks[i], np.int64) for i in part]), strict=True):
            out[i] = data
    return out


def _encode(blocks: list[np.ndarray]) -> list[bytes]:
    names, ranks = zip(*map(_named, blocks), strict=True)
    lengths = np.array([len(b) for b in blocks])
    longest, lanes = int(lengths[0]), len(blocks)
    ids = np.zeros((longest, lanes), np.int32)
    for i, r in enumerate(ranks):
        ids[: len(r), i] = r
    model = Model(np.array([len(x) for x in names]), False)
    low, span = np.zeros(lanes, np.int64), np.full(lanes, 1 << WIDE, np.int64)
    words, filled = np.zeros((lanes, longest + 4), np.uint32), np.ones(lanes, np.int64)  # word 0 stays empty
    for step in range(longest):
        n = int(np.searchsorted(-lengths, -step, side="left"))  # lengths fall: those above step
        model.begin(step, n)
        now = ids[step, :n].astype(np.int64)
        second = model.id2 != now
        third = second & (model.id1 != now)
        w21 = model.w2 + model.w1
        r = span[:n] >> BITS
        low[:n] += r * np.where(third, w21, second * model.w2)
        span[:n] = r * np.where(third, WHOLE - w21, np.where(second, model.w1, model.w2))
        rest = np.flatnonzero(third)
        both = model.spans[model.own1[rest] + now[rest]]
        r = span[rest] >> BITS
        low[rest] += r * (both >> 16)
        span[rest] = r * (both & 0xFFFF)
        over = np.flatnonzero(low[:n] >> WIDE)
        if len(over):
            low[over] &= (1 << WIDE) - 1
            _carry(words, over, filled[over] - 1)
        go = np.flatnonzero(span[:n] < 1 << SHORT)
        words[go, filled[go]] = low[go] >> SHORT
        filled[go] += 1
        low[go] = (low[go] & ((1 << SHORT) - 1)) << 32
        span[go] <<= 32
        model.learn(now, second.astype(np.int64) + third, n)
    for k in (SHORT, 0):
        words[np.arange(lanes), filled] = (low >> SHORT) if k else (low & ((1 << SHORT) - 1)) << 2
        filled += 1
    out = []
    for i, b in enumerate(blocks):
        body = words[i, 1 : filled[i]].astype("<u4").tobytes() if len(b) else b""
        out.append(MAGIC + struct.pack("<III", len(b), crc_of(b), len(names[i])) + _gaps(names[i]) + body)
    return out


def _carry(words: np.ndarray, lane: np.ndarray, at: np.ndarray) -> None:
    """Adds one to the last words written, and to those before them while they overflow."""
    while len(lane):
        words[lane, at] += np.uint32(1)
        more = words[lane, at] == 0
        lane, at = lane[more], at[more] - 1


def decode(data: list[bytes]) -> Iterator[np.ndarray]:
    """The ids of each block, checked against its checksum."""
    for at in range(0, len(data), LANES):
        yield from _decode(data[at : at + LANES])


def _decode(data: list[bytes]) -> list[np.ndarray]:
    heads = []
    for d in data:
        if len(d) < 15 or d[:3] != MAGIC:
            raise BadBlock("no block of ids")
        n, crc, distinct = struct.unpack("<III", d[3:15])
        names, at = _from_gaps(d, 15, distinct)
        heads.append((n, crc, names, at))
    order = sorted(range(len(data)), key=lambda i: -heads[i][0])
    lengths = np.array([heads[i][0] for i in order])
    bodies = [np.frombuffer(data[i], "<u4", (len(data[i]) - heads[i][3]) // 4, heads[i][3]) for i in order]
    model = Model(np.array([len(heads[i][2]) for i in order]), True)
    lanes, longest = len(order), int(lengths[0])
    words = np.zeros((lanes, max(map(len, bodies)) + 4), np.int64)
    for i, b in enumerate(bodies):
        words[i, : len(b)] = b
    ids = np.zeros((longest, lanes), np.int32)
    span, code = np.full(lanes, 1 << WIDE, np.int64), (words[:, 0] << SHORT) + (words[:, 1] >> 2)
    # the stream's bits below the interval's, two of them from the second word on
    taken, most = np.ones(lanes, np.int64), words.shape[1] - 1
    for step in range(longest):
        n = int(np.searchsorted(-lengths, -step, side="left"))
        model.begin(step, n)
        r = span[:n] >> BITS
        value = code[:n].view(np.uint64) // r.view(np.uint64)
        w21 = model.w2 + model.w1
        second, third = value >= model.w2.astype(np.uint64), value >= w21.astype(np.uint64)
        code[:n] -= r * np.where(third, w21, second * model.w2)
        span[:n] = r * np.where(third, WHOLE - w21, np.where(second, model.w1, model.w2))
        now = np.where(second, model.id1, model.id2).astype(np.int64)
        rest = np.flatnonzero(third)
        r = span[rest] >> BITS
        left = code[rest]
        value = np.minimum(left.view(np.uint64) // r.view(np.uint64), np.uint64(WHOLE - 1)).view(np.int64)
        found = model.places[model.own_slot[rest] + value]
        both = model.spans[model.own1[rest] + found]
        code[rest] = left - r * (both >> 16)
        span[rest] = r * (both & 0xFFFF)
        now[rest] = found
        ids[step, :n] = now
        go = np.flatnonzero(span[:n] < 1 << SHORT)
        at = taken[go]
        code[go] = (code[go] << 32) + ((words[go, at] & 3) << 30) + (words[go, np.minimum(at + 1, most)] >> 2)
        taken[go] = np.minimum(at + 1, most)
        span[go] <<= 32
        model.learn(now, second.astype(np.int64) + third, n)
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * lanes
    for k, i in enumerate(order):
        n, crc, names, _ = heads[i]
        got = names[ids[:n, k]] if n else np.zeros(0, np.int64)
        if crc_of(got) != crc:
            raise BadBlock("checksum")
        out[i] = got
    return out
