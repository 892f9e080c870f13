"""Block-compressed text: ranges of blocks, parts and their index; streamed hashes."""

import glob
import gzip
import hashlib
import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from locusloom.plans.derived import Tables
from locusloom.plans.registry import merged
from locusloom.session import stage
from locusloom.sinks import blocks as sink
from locusloom.sinks import ranges, vcf
from locusloom.sources import blocks, files
from locusloom.sources.vcf import read_vcf


def lines_in_ranges(path, size):
    whole = os.path.getsize(path)
    out = []
    for a in range(0, whole, size):
        for text in blocks.range_texts(blocks.Range(path, a, min(a + size, whole))):
            out += text.decode().removesuffix("\n").split("\n")
    return out


@pytest.mark.parametrize("seed", range(12))
def test_every_line_is_read_once_whatever_the_ranges(tmp_path, seed):
    rng = random.Random(seed)
    lines = ["x" * rng.choice([0, 1, 3, 50, 200, 3000]) + str(i) for i in range(rng.choice([1, 5, 300]))]
    text = ("\n".join(lines) + rng.choice(["", "\n"])).encode()
    step = rng.choice([7, 100, 1000, sink.BLOCK_TEXT])
    packed = b"".join(sink.block(text[i:i + step]) for i in range(0, len(text), step)) + rng.choice([b"", blocks.END_BLOCK])
    half = len(text) // 2
    for name, data in (("blocks", packed), ("plain", text), ("members", gzip.compress(text[:half]) + gzip.compress(text[half:]) + b"\0\0")):
        path = tmp_path / name
        path.write_bytes(data)
        for size in (max(len(data) // 97, 20), len(data) // 3 + 1, blocks.RANGE_BYTES):
            assert lines_in_ranges(str(path), size) == lines, (name, size)


def test_long_text_is_handed_on_in_pieces(tmp_path, monkeypatch):
    monkeypatch.setattr(blocks, "TEXT", 1000)
    lines = [f"line {i} " + "y" * (i % 90) for i in range(2000)]
    path = tmp_path / "x"
    path.write_bytes(b"".join(sink.block(x) for x in [("\n".join(lines)).encode()[i:i + 333] for i in range(0, 120_000, 333)]))
    assert lines_in_ranges(str(path), 1 << 20) == lines


def test_broken_blocks_are_errors(tmp_path):
    good = sink.block(b"one\ntwo\n") + sink.block(b"three\n")
    path = tmp_path / "x"
    for data in (good[:-3], good[:20] + b"\xff" + good[21:], good + b"rest"):
        path.write_bytes(data)
        with pytest.raises(blocks.BlockError):
            lines_in_ranges(str(path), 1 << 20)
    cut = gzip.compress(b"a\nb\n" * 1000)[:-10]
    path.write_bytes(cut)
    with pytest.raises(blocks.BlockError):
        lines_in_ranges(str(path), 1 << 20)


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    """150,000 lines of three chromosomes in four parts, two header lines before them."""
    path = str(tmp_path_factory.mktemp("blocks") / "out")
    rows = spark.range(0, 150_000, 1, 4).selectExpr(
        "cast(id div 50000 + 1 as int) AS chromosome", "id % 50000 * 37 AS position",
        "concat_ws('\t', id div 50000 + 1, id % 50000 * 37, 'rs' || id, md5(cast(id as string))) AS value")
    head = spark.createDataFrame([(0, -2, "##fileformat=VCFv4.3"), (0, -1, "#CHROM")], rows.schema)
    sink.write_block_text(head.unionAll(rows).coalesce(4), path)
    return path, rows


def test_parts_joined_are_one_file(written):
    path, rows = written
    data = b"".join(open(p, "rb").read() for p in sorted(glob.glob(f"{path}/data/part-*")))
    lines = gzip.decompress(data).decode().splitlines()
    assert data.endswith(blocks.END_BLOCK) and data.count(blocks.END_BLOCK) == 1
    assert lines[:2] == ["##fileformat=VCFv4.3", "#CHROM"] and lines[2:] == [r.value for r in rows.collect()]
    assert not os.path.exists(f"{path}/_attempts")


def test_one_file_is_read_by_many_tasks(spark, written, tmp_path):
    path, rows = written
    joined = tmp_path / "one.vcf.gz"
    joined.write_bytes(b"".join(open(p, "rb").read() for p in sorted(glob.glob(f"{path}/data/part-*"))))
    read = blocks.read_block_lines(spark, str(joined), 1 << 19)
    assert read.rdd.getNumPartitions() >= 4
    body = read.filter(~F.col("value").startswith("#")).select("value")
    assert body.count() == 150_000 and body.exceptAll(rows.select("value")).count() == 0
    ordered = [r.value for r in read.orderBy("file_path", "split_start", "row_id").select("value").collect()]
    assert ordered[2:] == [r.value for r in rows.collect()]


def test_region_reads_the_blocks_of_the_index(spark, written):
    path, rows = written
    for chromosome, first, last in ((2, 500_000, 900_000), (3, 0, 36), (1, 1_849_963, 9_000_000), (2, 38, 73), (9, 0, 10**9)):
        want = rows.filter((F.col("chromosome") == chromosome) & F.col("position").between(first, last)).select("value")
        got = sink.region_lines(spark, path, chromosome, first, last)
        assert sorted(r.value for r in got.collect()) == sorted(r.value for r in want.collect())
    index = sink.joined_index(spark, path).collect()
    data = b"".join(open(p, "rb").read() for p in sorted(glob.glob(f"{path}/data/part-*")))
    assert len(index) == 3 * (49_999 * 37 // 16384 + 1)
    for r in random.Random(0).sample(index, 40):
        text = gzip.decompress(data[r.offset >> 16:])[r.offset & 0xFFFF:]
        chromosome, position = text.split(b"\n", 1)[0].split(b"\t")[:2]
        assert (int(chromosome), int(position) >> 14) == (r.chromosome, r.window)


def test_writing_again_replaces_and_nothing_is_written_for_no_rows(spark, tmp_path):
    path = str(tmp_path / "out")
    for n in (1000, 10, 0):
        sink.write_block_text(spark.range(0, n, 1, 3).selectExpr("cast(id as string) AS value"), path)
        assert blocks.read_block_lines(spark, f"{path}/data").count() == n


def test_vcf_budget_over_plain_gzip_and_blocks(spark, tmp_path):
    good = "".join(f"1\t{p}\t.\tA\tG\t.\tPASS\tR2=0.9\tGT:DS\t0|0:0.5\n" for p in range(1, 200))
    (tmp_path / "a.vcf.gz").write_bytes(gzip.compress(b"##x\n" + good.encode()[:3000]) + gzip.compress(good.encode()[3000:]))
    (tmp_path / "b.vcf.gz").write_bytes(sink.block(good.encode()) + blocks.END_BLOCK)
    (tmp_path / "c.vcf").write_text(good.replace("\n", "\r\n"))
    read = read_vcf(spark, str(tmp_path))
    assert read.rows.count() == 3 * 199 and read.rejects.count() == 0 and read.report.count() == 3


def test_hash_of_a_file_above_a_piece(spark, tmp_path):
    data = random.Random(1).randbytes(3 * 1024 * 1024 + 17)
    (tmp_path / "x.vcf.gz").write_bytes(data)
    (tmp_path / "empty.txt").write_bytes(b"")
    assert files.file_sha256(str(tmp_path / "x.vcf.gz"), piece=1 << 20) == hashlib.sha256(data).hexdigest()
    got = {r.file_name: r for r in files.output_register(spark, str(tmp_path)).collect()}
    assert got["x.vcf.gz"].hash_sha256 == hashlib.sha256(data).hexdigest() and got["x.vcf.gz"].length == len(data)
    assert len(got) == 1  # Spark lists no empty files


def test_short_files_share_a_task():
    ranges = [blocks.Range("a", 0, 10), blocks.Range("b", 0, 10), blocks.Range("c", 0, 100), blocks.Range("c", 100, 200), blocks.Range("d", 0, 5)]
    assert [[r.path for r in g.ranges] for g in blocks.grouped(ranges, 100)] == [["a", "b"], ["c"], ["c"], ["d"]]


def test_vcf_parts_follow_the_number_of_rows(spark, sf_dir, tmp_path, monkeypatch):
    """Few bytes in many wide rows are still written by as many tasks as their rows ask for, in order."""
    rows = stage(merged(Tables(spark, sf_dir)), "rows")
    monkeypatch.setattr(ranges, "RANGE_ROWS", 50)
    vcf.write_block_vcf(rows, str(tmp_path / "out"), ["##x", "#CHROM"], staged=True)
    parts = sorted(glob.glob(f"{tmp_path}/out/data/part-*"))
    assert len(parts) == -(-rows.count() // 50) + 1  # the last is the empty block
    lines = gzip.decompress(b"".join(open(p, "rb").read() for p in parts)).decode().splitlines()
    assert lines[:2] == ["##x", "#CHROM"] and lines[2:] == [
        r.value for r in vcf.multi_sample_lines(rows).orderBy("chromosome", "position", "ref_allele", "alt_allele").collect()]


def test_short_ranges_of_a_long_folder_are_joined(spark, tmp_path):
    """Reading in ranges of 20 bytes takes no task for each of them."""
    lines = [f"line {i}" for i in range(20_000)]
    (tmp_path / "x").write_text("\n".join(lines))
    read = blocks.read_block_lines(spark, str(tmp_path / "x"), 20)
    assert 8 <= read.rdd.getNumPartitions() <= 16
    assert [r.value for r in read.orderBy("split_start", "row_id").collect()] == lines
    assert blocks._range_step(10**12, 1 << 16, 100) == blocks.RANGE_BYTES and blocks._range_step(10**12, 1 << 30, 100) == 1 << 30


def test_a_null_line_is_an_error():
    with pytest.raises(ValueError):
        sink._Part(None).add(pa.array(["a", None]), None, None)


def test_lines_of_odd_bytes():
    assert blocks._lines(b"a\r\n\xff\rb\r\r\n\n\n").to_pylist() == ["a", "\ufffd\rb\r", "", ""]
