"""Block-compressed text (BGZF) with a linear index, and reads of regions through it.

A frame of ordered lines becomes ``data/part-N.vcf.gz`` below a folder. Joined in name order the parts are one valid file: every
part is whole blocks, and the last part is the empty block that ends a file. Beside them ``index/part-N.tsv`` holds, for every
window of 16,384 positions, the virtual offset (byte of the block, byte within its text) of the first line that starts in it.
Tasks write under names of their own attempt; parts get their names when the whole write commits.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage

from locusloom.sources.blocks import BLOCK_HEAD, END_BLOCK, BlockText, file_system, load_ranges
from locusloom.sources.files import list_files

#: Bytes of text in a block, so that a block is below 64 KB even where its text can't be compressed.
BLOCK_TEXT = 65280
#: Fixed value: positions of one window, as a power of two.
WINDOW_BITS = 14

_INDEX = "chromosome int, window bigint, offset bigint"


def block(text: bytes, level: int = 6) -> bytes:
    """One BGZF member."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(text) + packer.flush()
    size = len(BLOCK_HEAD) + 2 + len(body) + 8
    return BLOCK_HEAD + struct.pack("<H", size - 1) + body + struct.pack("<II", zlib.crc32(text), len(text))


class _Part:
    """One part file in the making: full blocks are written as they fill up."""

    def __init__(self, out):
        self.out, self.rest, self.taken, self.starts = out, bytearray(), 0, [0]
        self.places: list[tuple[int, int, int]] = []  # chromosome, window, byte of the text
        self.last = (None, None)

    def add(self, lines: pa.Array, chromosomes: pa.Array | None, positions: pa.Array | None) -> None:
        """Lines as Arrow strings, and their places."""
        if lines.null_count:
            raise ValueError("a line is null")
        ended = pc.binary_join_element_wise(lines, pa.scalar("", lines.type), pa.scalar("\n", lines.type)).cast(pa.large_string())
        ends = np.frombuffer(ended.buffers()[1], np.int64, len(ended) + 1, ended.offset * 8)
        text = memoryview(ended.buffers()[2])[int(ends[0]):int(ends[-1])]
        if chromosomes is not None and positions is not None:
            self._index(chromosomes, positions, self.taken + ends[:-1] - ends[0])
        self.taken += len(text)
        self.rest += text
        full = len(self.rest) // BLOCK_TEXT * BLOCK_TEXT
        for at in range(0, full, BLOCK_TEXT):
            self._write(bytes(self.rest[at:at + BLOCK_TEXT]))
        del self.rest[:full]

    def _index(self, chromosomes: pa.Array, positions: pa.Array, begin: np.ndarray) -> None:
        """Note where a window starts: lines whose place is in another one than that of the line with a place before them."""
        placed = pc.and_(pc.not_equal(pc.fill_null(chromosomes, 0), 0), pc.greater_equal(pc.fill_null(positions, -1), 0))
        at = np.flatnonzero(placed.to_numpy(zero_copy_only=False))
        if not len(at):
            return
        c = pc.fill_null(chromosomes, 0).to_numpy(zero_copy_only=False)[at]
        w = pc.fill_null(positions, 0).to_numpy(zero_copy_only=False)[at] >> WINDOW_BITS
        new = np.ones(len(at), bool)
        new[1:] = (c[1:] != c[:-1]) | (w[1:] != w[:-1])
        new[0] = (int(c[0]), int(w[0])) != self.last
        self.places += zip(c[new].tolist(), w[new].tolist(), begin[at[new]].tolist())
        self.last = (int(c[-1]), int(w[-1]))

    def _write(self, text: bytes) -> None:
        data = block(text)
        self.out.write(data)
        self.starts.append(self.starts[-1] + len(data))

    def close(self) -> str:
        """Write what is left; the index as text."""
        if self.rest:
            self._write(bytes(self.rest))
        self.out.close()
        return "".join(f"{c}\t{w}\t{self.starts[at // BLOCK_TEXT] << 16 | at % BLOCK_TEXT}\n" for c, w, at in self.places)


@dataclass
class Written(WriterCommitMessage):
    number: int
    name: str


class BlockWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, top = file_system(self.path)
        task = TaskContext.get()
        name = f"{task.partitionId():05d}-{task.taskAttemptId()}"
        part = None
        for batch in iterator:
            if batch.num_rows == 0:
                continue
            if part is None:
                system.create_dir(f"{top}/_attempts", recursive=True)
                part = _Part(system.open_output_stream(f"{top}/_attempts/{name}.vcf.gz", compression=None))
            columns = dict(zip(batch.schema.names, batch.columns))
            part.add(columns["value"], columns.get("chromosome"), columns.get("position"))
        if part is None:
            return Written(task.partitionId(), "")
        with system.open_output_stream(f"{top}/_attempts/{name}.tsv") as out:
            out.write(part.close().encode())
        return Written(task.partitionId(), name)

    def commit(self, messages: list[Written | None]) -> None:
        system, top = file_system(self.path)
        kept = sorted((m for m in messages if m is not None and m.name), key=lambda m: m.number)
        for folder in ("data", "index"):
            if self.overwrite:
                system.delete_dir_contents(f"{top}/{folder}", missing_dir_ok=True)
            elif system.get_file_info(f"{top}/{folder}").type != arrow_fs.FileType.NotFound:
                raise FileExistsError(f"{top}/{folder}")
            system.create_dir(f"{top}/{folder}", recursive=True)
        for m in kept:
            system.move(f"{top}/_attempts/{m.name}.vcf.gz", f"{top}/data/part-{m.number:05d}.vcf.gz")
            system.move(f"{top}/_attempts/{m.name}.tsv", f"{top}/index/part-{m.number:05d}.tsv")
        with system.open_output_stream(f"{top}/data/part-{max((m.number for m in kept), default=-1) + 1:05d}.vcf.gz", compression=None) as out:
            out.write(END_BLOCK)
        self._clean(system, top)

    def abort(self, messages: list[Written | None]) -> None:
        self._clean(*file_system(self.path))

    def _clean(self, system: arrow_fs.FileSystem, top: str) -> None:
        if system.get_file_info(f"{top}/_attempts").type != arrow_fs.FileType.NotFound:
            system.delete_dir(f"{top}/_attempts")


def write_block_text(lines: DataFrame, path: str) -> None:
    """Write ``value`` in the frame's order; lines with ``chromosome`` (above 0) and ``position`` are indexed."""
    lines.sparkSession.dataSource.register(BlockText)
    columns = [c for c in ("value", "chromosome", "position") if c in lines.columns]
    lines.select(*columns).write.format("block_text").mode("overwrite").option("path", path).save()


def _part_number(path: str = "path") -> Column:
    return F.regexp_extract(path, r"part-([0-9]+)\.", 1).cast("int")


def block_index(spark: SparkSession, path: str) -> DataFrame:
    """part, chromosome, window, offset (in the part) and end: where the part's next window, or the part, ends."""
    rows = spark.read.schema(_INDEX).csv(f"{path}/index", sep="\t").select(
        _part_number(F.col("_metadata.file_path")).alias("part"), "chromosome", "window", "offset")
    sizes = list_files(spark, f"{path}/data").select(_part_number().alias("part"), "path", "length")
    following = F.lead("offset").over(Window.partitionBy("part").orderBy("offset"))  # windows of one part
    return rows.withColumn("end", following).join(F.broadcast(sizes), "part").withColumn(
        "end", F.coalesce("end", F.col("length") * 65536))


def joined_index(spark: SparkSession, path: str) -> DataFrame:
    """chromosome, window and virtual offset in the file that the parts joined in name order make."""
    sizes = list_files(spark, f"{path}/data").select(_part_number().alias("part"), "length")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    starts = sizes.select("part", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("start"))
    rows = block_index(spark, path).join(F.broadcast(starts), "part")
    return rows.groupBy("chromosome", "window").agg(F.min(F.col("offset") + F.col("start") * 65536).alias("offset"))


def region_lines(spark: SparkSession, path: str, chromosome: int, first: int, last: int) -> DataFrame:
    """The lines of one region: only the blocks that the index names are read, one task per part they are in."""
    windows = F.col("window").between(first >> WINDOW_BITS, last >> WINDOW_BITS)
    found = block_index(spark, path).filter((F.col("chromosome") == chromosome) & windows).groupBy("part", "path").agg(
        F.min("offset").alias("start"), F.max("end").alias("end")).collect()  # at most one row per part
    lines = load_ranges(spark, sorted((r.path, r.start, r.end, True) for r in found))
    position = F.try_element_at(F.split("value", "\t", 3), F.lit(2)).try_cast("bigint")
    return lines.filter(position.between(first, last))
