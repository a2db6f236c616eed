"""A Spark data source of zip archives: members are read where they lie, on the executors, without unpacking the archive anywhere.

The driver reads each archive's central directory, which is at its end, and deals the members out by their compressed
sizes; a task seeks to its members and inflates them as streams, so that a member of any size passes through a buffer. Paths are
local or of any store that pyarrow's file systems reach.

Options: ``path`` (a file, a folder, or a pattern with ``*``; several with commas), ``members`` (a pattern of names, ``*`` by default), ``bytes`` (compressed bytes of a
partition, 64 MB by default), ``errors`` (``raise``, or ``skip`` for archives that can't be read and members that are encrypted or damaged).

Rows: ``archive, member, line`` (from 0)``, value``: lines without their end, as UTF-8 where bytes that aren't become U+FFFD. Folders and empty
members give no rows; names may repeat in an archive, and each is read; an archive without members gives none.
"""

from __future__ import annotations

import fnmatch
import io
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PART_BYTES, BATCH, CHUNK = 64 << 20, 4096, 1 << 20
SCHEMA = "archive string, member string, line long, value string"
_ROW = pa.schema([("archive", pa.string()), ("member", pa.string()), ("line", pa.int64()), ("value", pa.string())])


class _Seekable(io.RawIOBase):
    """A store's file as Python's zip reader wants it: places before the start are an ``OSError``."""

    def __init__(self, f):
        self.f, self.size = f, f.size()

    def seekable(self) -> bool:
        return True

    def readable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.f.tell()

    def seek(self, at: int, whence: int = 0) -> int:
        to = at + (0 if whence == 0 else self.f.tell() if whence == 1 else self.size)
        if to < 0:
            raise OSError("before the start")
        self.f.seek(to)
        return to

    def read(self, n: int = -1) -> bytes:
        return self.f.read(None if n is None or n < 0 else n)


@dataclass
class Member:
    archive: str
    name: str
    at: int
    packed: int
    method: int
    crc: int
    plain: bool


class Members(InputPartition):
    def __init__(self, members: list[Member]):
        super().__init__(None)
        self.members = members


def _open(path: str):
    fs, inner = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    return fs, inner


def _archives(paths: str) -> list[str]:
    found = []
    for path in (p.strip() for p in paths.split(",")):
        fs, inner = _open(path)
        prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
        if "*" in inner:
            folder, _, name = inner.rpartition("/")
            listed = fs.get_file_info(pafs.FileSelector(folder or ".", allow_not_found=True))
            found += [prefix + f.path for f in sorted(listed, key=lambda f: f.path) if f.is_file and fnmatch.fnmatchcase(f.base_name, name)]
        elif fs.get_file_info(inner).type == pafs.FileType.Directory:
            found += [prefix + f.path for f in sorted(fs.get_file_info(pafs.FileSelector(inner, recursive=True)), key=lambda f: f.path) if f.is_file and f.base_name.endswith(".zip")]
        else:
            found.append(path)
    return found


def members(path: str, pattern: str = "*") -> list[Member]:
    """An archive's members by its central directory; nothing else of it is read."""
    fs, inner = _open(path)
    with fs.open_input_file(inner) as f, zipfile.ZipFile(_Seekable(f)) as z:
        return [Member(path, i.filename, i.header_offset, i.compress_size, i.compress_type, i.CRC, not i.flag_bits & 1) for i in z.infolist() if not i.is_dir() and fnmatch.fnmatchcase(i.filename, pattern)]


def _inflated(m: Member) -> Iterator[bytes]:
    """A member's bytes, piece by piece, checked against its checksum."""
    if not m.plain:
        raise ValueError(f"{m.archive}: {m.name} is encrypted")
    if m.method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        raise ValueError(f"{m.archive}: {m.name} is packed by method {m.method}")
    fs, inner = _open(m.archive)
    with fs.open_input_file(inner) as f:
        f.seek(m.at)
        head = f.read(30)
        if len(head) < 30 or head[:4] != b"PK\3\4":
            raise ValueError(f"{m.archive}: {m.name} isn't where the directory says")
        name, extra = struct.unpack("<HH", head[26:30])
        f.seek(m.at + 30 + name + extra)
        left, crc = m.packed, 0
        unpack = zlib.decompressobj(-15) if m.method == zipfile.ZIP_DEFLATED else None
        while left:
            data = f.read(min(CHUNK, left))
            if not data:
                raise ValueError(f"{m.archive}: {m.name} is cut off")
            left -= len(data)
            while data:
                piece = unpack.decompress(data, CHUNK) if unpack else data
                data = unpack.unconsumed_tail if unpack else b""
                crc = zlib.crc32(piece, crc)
                if piece:
                    yield piece
        if unpack and (piece := unpack.flush()):
            crc = zlib.crc32(piece, crc)
            yield piece
        if crc != m.crc:
            raise ValueError(f"{m.archive}: {m.name} is damaged")


def lines(pieces: Iterator[bytes]) -> Iterator[str]:
    """Lines of a stream of bytes, without ``\\n`` or ``\\r\\n``; a last line needs no end."""
    rest = b""
    for piece in pieces:
        *whole, rest = (rest + piece).split(b"\n")
        for w in whole:
            yield w.removesuffix(b"\r").decode("utf-8", "replace")
    if rest:
        yield rest.removesuffix(b"\r").decode("utf-8", "replace")


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options.get("path") or ""
        self.pattern, self.bytes = options.get("members", "*"), int(options.get("bytes", PART_BYTES))
        self.skip = options.get("errors", "raise") == "skip"
        if not self.path:
            raise ValueError("option path names no archive")

    def partitions(self) -> list[Members]:
        parts: list[list[Member]] = [[]]
        held = 0
        for archive in _archives(self.path):
            try:
                found = members(archive, self.pattern)
            except (zipfile.BadZipFile, OSError):
                if self.skip:
                    continue
                raise
            for m in found:
                if parts[-1] and held + m.packed > self.bytes:
                    parts.append([])
                    held = 0
                parts[-1].append(m)
                held += m.packed
        return [Members(p) for p in parts if p] or [Members([])]

    def read(self, partition: Members) -> Iterator[pa.RecordBatch]:
        for m in partition.members:
            if self.skip:
                try:
                    for _ in _inflated(m):
                        pass
                except (ValueError, zlib.error):
                    continue
            held: list[str] = []
            first = 0
            for value in lines(_inflated(m)):
                held.append(value)
                if len(held) == BATCH:
                    yield self._batch(m, first, held)
                    first, held = first + len(held), []
            if held:
                yield self._batch(m, first, held)

    @staticmethod
    def _batch(m: Member, first: int, held: list[str]) -> pa.RecordBatch:
        n = len(held)
        return pa.RecordBatch.from_arrays([pa.array([m.archive] * n), pa.array([m.name] * n), pa.array(range(first, first + n), pa.int64()), pa.array(held)], schema=_ROW)


class ZipLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zip_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def zip_lines(spark: SparkSession, path: str, members: str = "*", **options: str) -> DataFrame:
    """``archive, member, line, value`` of the text members of zip archives."""
    spark.dataSource.register(ZipLines)
    return spark.read.format("zip_lines").options(members=members, **options).load(path)


def span_gold(rows: DataFrame, labels: tuple[str, ...] = ("Chemical", "Disease"), kind: str = "CID") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, mentions and relations of annotated documents in ``rows`` (member, line, value), a corpus that comes as an archive.

    As files.py reads them from text files: documents ``paper_id, text``, mentions with offsets, relations of ``kind``.
    """
    from . import files

    return files.documents_of(rows), files.mentions_of(rows, labels), files.relations_of(rows, kind)


def paper_ids(rows: DataFrame) -> DataFrame:
    """The distinct ids of the documents in ``rows``, those with a title line."""
    return rows.select(F.regexp_extract("value", r"^([^|\t]+)\|t\|", 1).alias("paper_id")).filter("paper_id <> ''").distinct()


def check_labels(named: list[str], wanted: dict[int, str]) -> None:
    """Raises unless a source's own list of tag names is the one that numbers are read by."""
    if len(named) != len(wanted) or any(wanted.get(i) != name for i, name in enumerate(named)):
        raise ValueError(f"the source names {named}, read as {wanted}")
