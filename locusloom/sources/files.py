"""Input listings: classification by name, completeness and an ingest manifest."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locusloom.functions.text import base_name, file_extension, safe_file_name
from locusloom.schemas import AUTOSOMES

MB = 1024 * 1024
# Largest accepted size by declared type, and the cap of the library rule.
SIZE_CAPS = {"genome": 100 * MB, "vcf": 200 * MB, "pgs": 10 * MB}
LIBRARY_CAP = 500 * MB
# Accepted extensions, and the beginning of gzip data.
EXTENSIONS = ["txt", "vcf.gz", "vcf.gz.tbi", "pgs"]
GZIP_MAGIC = "1F8B08"
_HEAD_BYTES = 65536
#: Bytes of a file that are hashed at a time.
HASH_PIECE = 4 * MB


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """path, file_name, length, modified; file contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(
        "path", base_name("path").alias("file_name"), "length", F.col("modificationTime").alias("modified"),
    )


def classify_name(name: Column) -> Column:
    """``genome``, ``vcf``, ``pgs`` or ``other`` as uploads are told apart."""
    scores = name.contains("scores")
    return (
        F.when(name.endswith(".txt") & ~scores, F.lit("genome"))
        .when(name.endswith(".vcf.gz") | name.endswith(".vcf"), F.lit("vcf"))
        .when(scores & name.endswith(".txt"), F.lit("pgs"))
        .otherwise(F.lit("other"))
    )


def classify_name_strict(name: Column) -> Column:
    """The naming rule of complete file sets: genome_*.txt, chr*.dose.vcf.gz, scores.txt."""
    return (
        F.when(name.startswith("genome_") & name.endswith(".txt"), F.lit("genome"))
        .when(name.startswith("chr") & name.endswith(".dose.vcf.gz"), F.lit("vcf"))
        .when(name == "scores.txt", F.lit("pgs"))
        .otherwise(F.lit("other"))
    )


def classify_files(files: DataFrame, strict: bool = False) -> DataFrame:
    rule = classify_name_strict if strict else classify_name
    return files.withColumn("file_type", rule(F.col("file_name")))


def missing_inputs(files: DataFrame) -> DataFrame:
    """One row per problem of a strict file set; no row means complete."""
    spark = files.sparkSession
    typed = classify_files(files, strict=True)
    wanted = spark.range(AUTOSOMES.start, AUTOSOMES.stop).select(
        F.concat(F.lit("chr"), F.col("id").cast("string"), F.lit(".dose.vcf.gz")).alias("item")
    ).unionAll(spark.range(1).select(F.explode(F.array(F.lit("genome"), F.lit("pgs"))).alias("item")))
    found = typed.filter(F.col("file_type") == "vcf").select(
        F.regexp_extract("file_name", r"chr([0-9]+)\.dose\.vcf\.gz", 0).alias("item")
    ).unionAll(typed.filter(F.col("file_type").isin("genome", "pgs")).select(F.col("file_type").alias("item")))
    missing = wanted.join(found.distinct(), "item", "left_anti").select(
        F.concat(F.lit("missing "), F.col("item")).alias("problem")
    )
    extra = typed.agg(F.count_if(F.col("file_type") == "vcf").alias("n")).filter(F.col("n") != len(AUTOSOMES)).select(
        F.concat(F.lit("expected 22 VCF files, found "), F.col("n").cast("string")).alias("problem")
    )
    return missing.unionAll(extra)


@F.pandas_udf(T.StringType())
def _gzip_first_line(head: pd.Series) -> pd.Series:
    """First text line of a gzip stream from the file's first bytes."""
    def first(data: bytes | None) -> str | None:
        try:
            text = zlib.decompressobj(zlib.MAX_WBITS | 16).decompress(data or b"", _HEAD_BYTES)
        except zlib.error:
            return None
        return text.split(b"\n", 1)[0].decode("utf-8", "replace") if text else None

    return head.map(first)


def manifest_checks(files: DataFrame) -> DataFrame:
    """Add safe_name, extension and name/size ``reason`` to a frame with file_name, file_type, length."""
    cap = F.create_map(*[v for t, n in SIZE_CAPS.items() for v in (F.lit(t), F.lit(n))])
    safe = safe_file_name("file_name")
    extension = file_extension(safe, score_files=True)
    limit = F.coalesce(F.try_element_at(cap, F.col("file_type")), F.lit(LIBRARY_CAP))
    return files.withColumns({"safe_name": safe, "extension": extension}).withColumn(
        "reason",
        F.when(F.col("length") > limit, F.lit("file too large"))
        .when(F.col("safe_name") == "", F.lit("invalid file name"))
        .when(F.col("safe_name").startswith("."), F.lit("hidden file name"))
        .when(~F.col("extension").isin(EXTENSIONS), F.lit("invalid file type")),
    )


def call_text_reason(text: Column) -> Column:
    """Why a calls text is refused: first line and field count of the first data line."""
    first = F.substring_index(text, "\n", 1)
    rest = text.substr(F.length(first) + 2, F.length(text))
    data = F.regexp_extract(rest, r"(?m)^(?!#)(?=[^\n]*\S)[^\n]*$", 0)
    return (
        F.when(F.length(text) == 0, F.lit("file is empty"))
        .when(~(first.contains("23andMe") | first.startswith("#")), F.lit("not a calls file"))
        .when((data != "") & (F.size(F.split(F.trim(F.regexp_replace(data, r"\s+", " ")), " ")) != 4), F.lit("expected 4 columns"))
    )


def score_text_reason(text: Column) -> Column:
    data = F.regexp_extract(text, r"(?m)^(?!#)(?=[^\n]*\S)[^\n]*$", 0)
    fields = F.size(F.split(F.trim(F.regexp_replace(data, r"[\s,]+", " ")), " "))
    return F.when((data != "") & (fields < 2), F.lit("expected at least 2 columns"))


def ingest_manifest(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """One row per file: names, type, size, SHA-256, and ``reason`` when it is refused.

    Contents are checked by declared type. Files over their cap are refused from the listing;
    the size filter reaches the source, which then does not open them.
    """
    listed = manifest_checks(classify_files(list_files(spark, path), strict))
    columns = ["path", "file_name", "safe_name", "file_type", "extension", "length", "hash_sha256", "reason"]
    refused = listed.filter(F.col("reason").isNotNull()).withColumn("hash_sha256", F.lit(None).cast("string"))

    contents = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter(
        F.col("length") <= LIBRARY_CAP
    ).select("path", base_name("path").alias("file_name"), "length", "content")
    body = manifest_checks(classify_files(contents, strict)).filter(F.col("reason").isNull())
    text = F.decode("content", "UTF-8")
    gz = F.col("extension").isin("vcf.gz", "vcf.gz.tbi")
    magic = F.hex(F.substring("content", 1, 3))
    head = F.when(F.col("extension") == "vcf.gz", F.substring("content", 1, _HEAD_BYTES))
    body = body.withColumn("_first", _gzip_first_line(head)).withColumn(
        "reason",
        F.when(gz & (magic != GZIP_MAGIC), F.lit("magic number mismatch"))
        .when((F.col("extension") == "vcf.gz") & ~F.coalesce(F.col("_first").startswith("##fileformat=VCFv4."), F.lit(False)), F.lit("missing fileformat header"))
        .when((F.col("extension") == "txt") & (F.col("file_type") == "genome"), call_text_reason(text))
        .when(~gz & (F.col("file_type") == "pgs"), score_text_reason(text)),
    ).withColumn("hash_sha256", F.sha2("content", 256))
    return body.select(columns).unionByName(refused.select(columns))


def hashed_files(files: DataFrame) -> DataFrame:
    """Add ``hash_sha256`` to a listing with ``path``: each file is streamed through one task in pieces, whatever its size."""
    kept = [c for c in files.columns if c != "hash_sha256"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column(batch.schema.get_field_index("path")).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([file_sha256(p) for p in paths], type=pa.string())], names=[*batch.schema.names, "hash_sha256"])

    spread = files.select(*kept).repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")
    return spread.mapInArrow(work, T.StructType([*spread.schema.fields, T.StructField("hash_sha256", T.StringType())]))


def file_sha256(path: str, piece: int = HASH_PIECE) -> str:
    from locusloom.sources.blocks import file_system

    system, name = file_system(path)
    digest = hashlib.sha256()
    with system.open_input_stream(name, compression=None) as file:
        while data := file.read(piece):
            digest.update(data)
    return digest.hexdigest()


def output_register(spark: SparkSession, path: str) -> DataFrame:
    """file_name, file_type, length and SHA-256 of written files, of any size: files are streamed, never held whole.

    Empty files are not listed, as Spark's reader leaves them out.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind = F.when(F.col("path").contains("vcf"), F.lit("vcf")).otherwise(F.lit("result"))
    return hashed_files(listed.select("path", base_name("path").alias("file_name"), kind.alias("file_type"), "length"))
