"""Token ids of a corpus as a coded binary dataset, in order of document ids, and its reader.

Texts are range-partitioned by document id; each partition becomes a part: its documents' ids, each document closed by the end id,
stand one after another and are cut into blocks of ``idcoder.BLOCK`` ids, coded independently. A block is a row of the
dataset's files (Parquet keeps them whole on any store and commits them once, whatever executor is lost):

    part, first   the part, and the place of the block's first id in it
    n             ids of the block
    docs          for each document with ids in the block: its place in the part, its id, its ids here, and how many of its ids follow after the block
    data          the coded ids with their checksum (``idcoder``)

So a reader needs no row but the block's own; what it finds of a document that goes on in other blocks adds up, the checksum too,
as a CRC is linear.

White space never becomes a token and no token spans it, so a text's ids are those of its words between blanks and line feeds, of a tokenizer
that lower-cases and splits letters from punctuation, as ``word_bpe_49k.json`` does (``Words`` refuses others). Each batch's distinct words are encoded once, by the tokenizers library, and remembered by the worker up to a bound.

Defined results: null and empty texts have the end id only; a null doc_id stands first; rows of one id stand in order of a
digest of their texts, and each is its own document; an empty table makes an empty dataset. Other columns aren't read.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import idcoder
from .common import shared_folder
from .ordered import spread

#: The id that closes a document.
END = 1
#: Characters of texts that are split at once, and words that a worker remembers.
CHARS, WORDS = 4_000_000, 500_000
#: What the vocabulary's names of tokens at the end of a piece end with.
PIECE_END = "</w>"
#: Words that are encoded together, and such texts at once: the library's results are large.
JOINED, AT_ONCE = 256, 64

SCHEMA = "part int, first long, n int, docs array<struct<at: long, doc_id: long, ids: int, left: long>>, data binary"
_DOC = pa.struct([("at", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.int32()), ("left", pa.int64())])
_ROW = pa.schema([("part", pa.int32()), ("first", pa.int64()), ("n", pa.int32()), ("docs", pa.list_(_DOC)), ("data", pa.binary())])


def vocabulary(name: str) -> str:
    """The place of an installed public vocabulary, the same on all executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Words:
    """Ids of words, encoded once each; the oldest go when there are too many."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task a core
        self.tokenizer = Tokenizer.from_file(path)
        for a, b in (("Ab. c,d\n\ne", "ab .  c ,d e"), ("x", " X ")):
            if not np.array_equal(self._whole(a), self._whole(b)):
                raise ValueError("a tokenizer that minds case or white space")
        names = self.tokenizer.get_vocab()
        self.last = np.zeros(max(names.values()) + 1, bool)  # tokens that end a piece
        self.last[[i for name, i in names.items() if name.endswith(PIECE_END)]] = True
        self.known: dict[str, int] = {}
        self._clear()

    def _clear(self) -> None:
        self.known.clear()
        self.flat, self.ends, self.total = [np.zeros(0, np.uint16)], [np.zeros(1, np.int64)], 0

    def _encode(self, texts: list[str]) -> Iterator:
        for i in range(0, len(texts), AT_ONCE):
            yield from self.tokenizer.encode_batch_fast(texts[i : i + AT_ONCE], add_special_tokens=False)

    def _add(self, words: list[str]) -> None:
        alone, flat, sizes, named = [], [], [], []
        letters = [w for w in words if w.isalpha()]
        groups = [letters[i : i + JOINED] for i in range(0, len(letters), JOINED)]
        for group, got in zip(groups, self._encode([" ".join(g) for g in groups]), strict=True):
            # a word of letters is one piece of the library's own, and a piece ends with a token of its end; where it isn't, the words go alone
            ids = np.array(got.ids, np.uint32)
            stops = np.flatnonzero(self.last[ids]) + 1
            if len(stops) == len(group):
                flat.append(ids)
                sizes.append(np.diff(stops, prepend=0))
                named += group
            else:
                alone += group
        alone += [w for w in words if not w.isalpha()]
        for w, got in zip(alone, self._encode(alone), strict=True):
            flat.append(np.array(got.ids, np.uint32))
            sizes.append(np.array([len(got.ids)]))
            named.append(w)
        ends = np.cumsum(np.concatenate(sizes))
        self.flat.append(np.concatenate(flat))
        self.ends.append(ends + self.total)
        self.total += len(self.flat[-1])
        self.known.update(zip(named, range(len(self.known), len(self.known) + len(named)), strict=True))

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and how many each has."""
        # ASCII letters in lower case, and a blank between a letter and ASCII punctuation other than ', change no piece; but they could make a special token's name
        special = pc.match_substring(texts, "<|")
        plain = pc.ascii_lower(pc.if_else(special, "", texts)) if pc.any(special).as_py() else pc.ascii_lower(texts)
        plain = pc.replace_substring_regex(plain, r"(\p{L})([!-&(-/:-@\[-`{-~])", r"\1 \2")
        lists = pc.split_pattern(pc.replace_substring(plain, "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.known) + len(words) > WORDS:
            self._clear()
        new = [w for w in words if w not in self.known]
        if new:
            self._add(new)
        if len(self.flat) > 1:
            self.flat, self.ends = [np.concatenate(self.flat)], [np.concatenate(self.ends)]
        ends, flat = self.ends[0], self.flat[0]
        number = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        begin, size = ends[number], ends[number + 1] - ends[number]
        place = coded.indices.to_numpy()
        begin, size = begin[place], size[place]
        upto = np.concatenate([[0], np.cumsum(size)])
        ids = flat[np.arange(upto[-1]) + np.repeat(begin - upto[:-1], size)]
        sizes = np.diff(upto[lists.offsets.to_numpy() - lists.offsets[0].as_py()])
        if special.true_count:
            parts = np.split(ids, np.cumsum(sizes)[:-1])
            for i in np.flatnonzero(special.to_numpy(zero_copy_only=False)):
                parts[i] = self._whole(texts[int(i)].as_py())
            ids, sizes = np.concatenate(parts), np.array([len(p) for p in parts])
        return ids, sizes


_WORDS: dict[str, Words] = {}


def _pieces(texts: pa.Array) -> Iterator[pa.Array]:
    """Slices of about ``CHARS`` characters; a longer text is one alone."""
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        done = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, done + CHARS, side="right")))
        yield texts.slice(at, to - at)
        at = to


def _rows(part: int, first: int, ids: np.ndarray, docs: list[list]) -> pa.RecordBatch:
    blocks = [ids[i : i + idcoder.BLOCK] for i in range(0, len(ids), idcoder.BLOCK)]
    data = idcoder.encode(blocks)
    firsts = first + np.arange(len(blocks), dtype=np.int64) * idcoder.BLOCK
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(blocks), part, np.int32)), pa.array(firsts), pa.array([len(b) for b in blocks], pa.int32()), pa.array(docs, pa.list_(_DOC)), pa.array(data, pa.binary())], schema=_ROW)


class _Part:
    """A part under way: ids not yet coded, and which documents they belong to."""

    def __init__(self, part: int):
        self.part, self.first, self.count = part, 0, 0
        self.ids: list[np.ndarray] = []
        self.held = 0
        self.docs: list[tuple] = []  # (place, doc_id, ids)
        self.begun = 0  # ids of the first of docs that are coded already

    def add(self, doc_ids: list, ids: np.ndarray, sizes: np.ndarray) -> None:
        closed = np.insert(ids, np.cumsum(sizes), END)
        self.ids.append(closed)
        self.held += len(closed)
        for d, n in zip(doc_ids, (sizes + 1).tolist(), strict=True):
            self.docs.append((self.count, d, n))
            self.count += 1

    def code(self, last: bool) -> pa.RecordBatch | None:
        """Rows of the full blocks, or of all."""
        n = self.held if last else self.held // idcoder.BLOCK * idcoder.BLOCK
        if not n:
            return None
        ids = np.concatenate(self.ids)
        docs, at, begun = [], 0, self.begun
        for block in range(0, n, idcoder.BLOCK):
            room, mine = min(idcoder.BLOCK, n - block), []
            while room:
                place, doc_id, size = self.docs[at]
                here = min(room, size - begun)
                mine.append({"at": place, "doc_id": doc_id, "ids": here, "left": size - begun - here})
                room, begun = room - here, begun + here
                if begun == size:
                    at, begun = at + 1, 0
            docs.append(mine)
        rows = _rows(self.part, self.first, ids[:n], docs)
        self.docs, self.begun, self.first = self.docs[at:], begun, self.first + n
        self.ids, self.held = [ids[n:]], self.held - n
        return rows


def _write(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _WORDS.setdefault(path, Words(path)) if path not in _WORDS else _WORDS[path]
        part = _Part(TaskContext.get().partitionId())
        for batch in batches:
            doc_ids, at = batch.column(0).to_pylist(), 0
            for texts in _pieces(batch.column(1)):
                ids, sizes = words.texts(texts)
                part.add(doc_ids[at : at + len(texts)], ids, sizes)
                at += len(texts)
                if part.held >= idcoder.BLOCK * idcoder.LANES:
                    yield part.code(False)
        rows = part.code(True)
        if rows is not None:
            yield rows

    return run


def write_ids(docs: DataFrame, path: str, folder: str | None = None, doc_id: str = "doc_id", text: str = "text") -> str:
    """Writes the ids of all texts by the tokenizer file ``path``, and returns the dataset's folder: ``folder``, or a new one in the shared folder."""
    folder = folder or f"{shared_folder(docs.sparkSession)}/ids-{uuid.uuid4().hex}"
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumns({"_h": F.xxhash64("text"), "_tie": F.monotonically_increasing_id()})
    spread(rows, "doc_id", "_h", "_tie").select("doc_id", "text").mapInArrow(_write(path), SCHEMA).write.parquet(folder)
    return folder


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """``part, at, doc_id, first`` (the place in the part of its first id here)``, ids`` of each document in each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("part", pa.int32()), ("at", pa.int64()), ("doc_id", pa.int64()), ("first", pa.int64()), ("ids", pa.list_(pa.int32()))])
        for rows in _decoded(batches):
            names = [[r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows], [r[5] for r in rows]]
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(names, schema, strict=True)], schema=schema)

    return spark.read.schema(SCHEMA).parquet(folder).mapInArrow(run, "part int, at long, doc_id long, first long, ids array<int>")


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """(part, place, doc_id, first, left, ids) of every document in every block."""
    for batch in batches:
        for i in range(0, batch.num_rows, idcoder.LANES):
            some = batch.slice(i, idcoder.LANES)
            part, first, docs, data = (some.column(c).to_pylist() for c in (0, 1, 3, 4))
            out = []
            for p, f, mine, ids in zip(part, first, docs, idcoder.decode(data), strict=True):
                at = 0
                for d in mine:
                    out.append((p, d["at"], d["doc_id"], f + at, d["left"], ids[at : at + d["ids"]]))
                    at += d["ids"]
                if at != len(ids):
                    raise idcoder.BadBlock("documents and ids differ")
            yield out


def _times(a: int, b: int) -> int:
    """The product of two CRC remainders (bit-reversed polynomials)."""
    out = 0
    for i in range(31, -1, -1):
        if a >> i & 1:
            out ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


def crc_before(crc: int, n: int) -> int:
    """What a CRC-32 counts for in that of its data followed by ``n`` more bytes."""
    power, square = 1 << 31, 1 << 23  # 1 and x ** 8
    while n:
        if n & 1:
            power = _times(power, square)
        square, n = _times(square, square), n >> 1
    return _times(crc, power)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("part", pa.int32()), ("at", pa.int64()), ("doc_id", pa.int64()), ("first", pa.int64()), ("n", pa.int64()), ("crc", pa.int64())])
    for rows in _decoded(batches):
        crc = [zlib.crc32(ids.astype("<u4").tobytes()) for *_, ids in rows]
        crc = [crc_before(c, 4 * r[4]) if r[4] else c for c, r in zip(crc, rows, strict=True)]
        names = [[r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows], [len(r[5]) for r in rows], crc]
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(names, schema, strict=True)], schema=schema)


def document_digests(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, from the decoded ids of a dataset."""
    rows = spark.read.schema(SCHEMA).parquet(folder)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    parts = rows.groupBy("part").agg(F.sum("n").alias("n")).select(F.col("part").alias("_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    found = rows.mapInArrow(_digests, "part int, at long, doc_id long, first long, n long, crc long")
    docs = found.groupBy("part", "at", "doc_id").agg(F.min("first").alias("first"), F.sum("n").alias("n_tokens"), F.bit_xor("crc").alias("ids_crc32"))
    return docs.join(parts, F.col("part") == F.col("_part")).select("doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
