"""Lines of block-compressed text (BGZF), read in ranges of blocks by many tasks.

BGZF is gzip in members of at most 64 KB that state their own length, so a task can start anywhere: it looks for the first
block that starts in its range of bytes, checks that another one follows it, and reads on from there. A line belongs to the range
in which the line before it ends, so one across a border is read once. Plain gzip, also of many members, has no such blocks
and is read by the task of its first range; uncompressed text is cut at any byte.

Files are opened inside the tasks through Arrow's file systems (local, hdfs, s3, gs and the like, by the scheme of the path).
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from locusloom.sources.files import list_files

#: The head of a BGZF member up to its length, and the empty member that ends a file.
BLOCK_HEAD = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff\x06\x00BC\x02\x00"
END_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
GZIP_HEAD = b"\x1f\x8b"
#: Bytes of a file that one task reads.
RANGE_BYTES = 32 << 20
#: Ranges for each shuffle partition from which on they get longer.
TASKS = 4
#: Bytes fetched from a file at a time, and text handed on at a time.
PIECE, TEXT = 1 << 20, 4 << 20

LINES = "value string, file_path string, split_start bigint, row_id bigint"


class BlockError(ValueError):
    """A block that can't be read."""


def file_system(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The Arrow file system of a path as Spark prints it, and the path in it."""
    local = re.match(r"^file:/+(.*)$", path)
    if local:
        path = "/" + local.group(1)
    return arrow_fs.FileSystem.from_uri(path)


class _File:
    """A file read in pieces, at any place."""

    def __init__(self, path: str):
        system, name = file_system(path)
        self.file = system.open_input_file(name)
        self.size = self.file.size()
        self.start, self.data = 0, b""

    def take(self, at: int, n: int) -> bytes:
        """n bytes from a place on, fewer at the end; places mostly grow."""
        if not (self.start <= at and at + n <= self.start + len(self.data)):
            self.start, self.data = at, self.file.read_at(min(max(n, PIECE), max(self.size - at, 0)), at) if at < self.size else b""
        return self.data[at - self.start:at - self.start + n]


def block_length(file: _File, at: int) -> int | None:
    """Bytes of the block that starts at a place; None if none does."""
    head = file.take(at, 12)
    if len(head) < 12 or head[:4] != BLOCK_HEAD[:4]:
        return None
    extra = file.take(at + 12, struct.unpack("<H", head[10:12])[0])
    i = 0
    while i + 4 <= len(extra):
        tag, n = extra[i:i + 2], struct.unpack("<H", extra[i + 2:i + 4])[0]
        if tag == b"BC" and n == 2 and i + 6 <= len(extra):
            return struct.unpack("<H", extra[i + 4:i + 6])[0] + 1
        i += 4 + n
    return None


def block_data(file: _File, at: int, length: int) -> bytes:
    """The text of one block, with its checks."""
    raw = file.take(at, length)
    skip = 12 + struct.unpack("<H", raw[10:12])[0]
    try:
        text = zlib.decompress(raw[skip:-8], wbits=-15)
    except zlib.error as error:
        raise BlockError(f"block at byte {at}: {error}") from error
    if len(raw) != length or struct.unpack("<II", raw[-8:]) != (zlib.crc32(text), len(text)):
        raise BlockError(f"block at byte {at}: length or checksum do not match")
    return text


def first_block(file: _File, at: int, end: int) -> int | None:
    """Where the first block that starts at ``at`` or later, but before ``end``, starts."""
    while at < end:
        piece = file.take(at, PIECE)
        found = piece.find(BLOCK_HEAD[:4])
        if found < 0:
            at += max(len(piece) - 3, 1)
            continue
        at += found
        length = block_length(file, at) if at < end else None
        if length and (at + length == file.size or block_length(file, at + length)):
            return at
        at += 1
    return None


def _blocks(file: _File, at: int) -> Iterator[tuple[int, bytes]]:
    while at < file.size:
        length = block_length(file, at)
        if length is None:
            raise BlockError(f"no block at byte {at}")
        yield at, block_data(file, at, length)
        at += length


def _plain(file: _File, at: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Uncompressed bytes, cut at the range's end."""
    while at < file.size:
        piece = file.take(at, min(PIECE, end - at) if at < end else PIECE)
        yield at, piece
        at += len(piece)


def _members(file: _File) -> Iterator[tuple[int, bytes]]:
    """Plain gzip of one or more members, as one stream."""
    at, member = 0, None
    while at < file.size:
        piece = file.take(at, PIECE)
        at += len(piece)
        while piece:
            if member is None:
                piece = piece.lstrip(b"\0")  # padding between members
                if not piece:
                    break
                member = zlib.decompressobj(wbits=31)
            try:
                yield 0, member.decompress(piece)
            except zlib.error as error:
                raise BlockError(f"gzip before byte {at}: {error}") from error
            piece = member.unused_data
            if member.eof:
                member = None
    if member is not None:
        raise BlockError("gzip ends inside a member")


def _texts(parts: Iterator[tuple[int, bytes]], end: int, skip: bool) -> Iterator[bytes]:
    """Whole lines, many at a time, of the parts that start before ``end``.

    ``skip``: what precedes the first line end belongs to an earlier range. The line that starts where the
    range ends belongs to it, and is read from the parts that follow.
    """
    held, size = [], 0
    for at, data in parts:
        cut = data.find(b"\n")
        if at >= end:
            if skip:
                return
            held.append(data if cut < 0 else data[:cut + 1])
            if cut >= 0:
                break
            continue
        if skip:
            if cut < 0:
                continue
            data, skip = data[cut + 1:], False
        held.append(data)
        size += len(data)
        if size >= TEXT:
            text = b"".join(held)
            cut = text.rfind(b"\n") + 1
            if cut:
                yield text[:cut]
            held, size = [text[cut:]], len(text) - cut if cut else 0
    text = b"".join(held)
    if text:
        yield text


@dataclass
class Range(InputPartition):
    """Bytes [start, end) of a file; ``exact``: virtual offsets of lines, as an index has them."""

    path: str
    start: int
    end: int
    exact: bool = False


def range_texts(part: Range) -> Iterator[bytes]:
    file = _File(part.path)
    if part.exact:
        yield from _exact_texts(file, part.start, part.end)
    elif file.take(0, 2) != GZIP_HEAD:
        yield from _texts(_plain(file, part.start, part.end), part.end, part.start > 0)
    elif block_length(file, 0) is None:
        if part.start == 0:
            yield from _texts(_members(file), file.size, False)
    else:
        first = first_block(file, part.start, part.end)
        if first is not None:
            yield from _texts(_blocks(file, first), part.end, part.start > 0)


def _exact_texts(file: _File, start: int, end: int) -> Iterator[bytes]:
    def parts() -> Iterator[tuple[int, bytes]]:
        for at, data in _blocks(file, start >> 16):
            if at > end >> 16 or (at == end >> 16 and not end & 0xFFFF):
                return
            data = data[:end & 0xFFFF] if at == end >> 16 else data
            yield 0, data[start & 0xFFFF:] if at == start >> 16 else data

    yield from _texts(parts(), 1, False)


@dataclass
class Group(InputPartition):
    """Ranges that one task reads one after another: short files together, a long file's ranges apart."""

    ranges: list[Range]


def grouped(ranges: list[Range], most: int) -> list[Group]:
    out, size = [], 0
    for r in ranges:
        own = (r.end >> 16) - (r.start >> 16) if r.exact else r.end - r.start
        if not out or size + own > most:
            out.append(Group([]))
            size = 0
        out[-1].ranges.append(r)
        size += own
    return out


def _lines(text: bytes) -> pa.Array:
    """The lines of whole lines of text, split by Arrow."""
    body = pa.array([text.decode("utf-8", "replace").removesuffix("\n")], type=pa.string())
    lines = pc.split_pattern(body, "\n").flatten()
    return pc.replace_substring_regex(lines, r"\r\z", "") if b"\r" in text else lines


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.ranges, self.most = [Range(*r) for r in json.loads(options["ranges"])], int(options["most"])

    def partitions(self) -> list[Group]:
        return grouped(self.ranges, self.most) or [Group([])]

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        for part in partition.ranges:
            n = 0
            for text in range_texts(part):
                lines = _lines(text)
                yield pa.RecordBatch.from_arrays(
                    [lines, pa.repeat(part.path, len(lines)), pa.repeat(pa.scalar(part.start, pa.int64()), len(lines)),
                     pa.array(np.arange(n, n + len(lines), dtype=np.int64))],
                    names=["value", "file_path", "split_start", "row_id"])
                n += len(lines)


class BlockText(DataSource):
    """``block_text``: reads ranges of block-compressed, gzip or plain text, and writes block-compressed parts."""

    @classmethod
    def name(cls) -> str:
        return "block_text"

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool):
        from locusloom.sinks.blocks import BlockWriter

        return BlockWriter(self.options, overwrite)


def load_ranges(spark: SparkSession, ranges: list[tuple], most: int = RANGE_BYTES) -> DataFrame:
    """The lines of ranges (path, start, end and, for virtual offsets, True), about ``most`` bytes to a task."""
    spark.dataSource.register(BlockText)
    return spark.read.format("block_text").option("ranges", json.dumps(ranges)).option("most", most).load()


def read_block_lines(spark: SparkSession, paths: str | list[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """value, file_path, split_start, row_id of files or folders: what ``read_lines`` gives, from many tasks a file.

    The driver lists names and lengths, as any read does; only the tasks open the files. A trailing carriage return is no part
    of a line, and bytes that are no UTF-8 are replaced. Where ranges of ``range_bytes`` would be very many, they are longer, up to
    ``RANGE_BYTES``: a task costs more to start than a short range to read.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    files = [r for path in paths for r in list_files(spark, path).filter("length > 0").select("path", "length").collect()]
    step = _range_step(sum(r.length for r in files), range_bytes, TASKS * int(spark.conf.get("spark.sql.shuffle.partitions")))
    return load_ranges(spark, sorted((r.path, a, min(a + step, r.length)) for r in files for a in range(0, r.length, step)), step)


def _range_step(total: int, range_bytes: int, tasks: int) -> int:
    return max(range_bytes, min(-(-total // tasks), RANGE_BYTES))
