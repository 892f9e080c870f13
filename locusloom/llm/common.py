"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusloom.session import stage, staged_path  # noqa: F401 - the operators take them from here

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows in one Arrow batch. A batch of whole texts stays at a few MB on average.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Send whole texts to Python in small batches, unless the session's owner chose a size."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def partitions(spark: SparkSession) -> int:
    """Number of partitions for a keyed exchange: what the session asks for, at least one per core."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def ranked(df: DataFrame, order: list[Column], name: str, stage_name: str) -> DataFrame:
    """Number rows from 0 in a total order, without bringing them together.

    Rows are sorted by ranges; the counts of the ranges (one number per partition) give the offsets.
    """
    columns = df.columns
    numbered = stage(df.sort(*order).select("*", F.monotonically_increasing_id().alias("__at")), stage_name)
    part = F.shiftright("__at", 33)
    counts = numbered.groupBy(part.alias("p")).count().collect()
    offsets, total = [], 0
    for p, n in sorted((r["p"], r["count"]) for r in counts):
        offsets.append((p, total))
        total += n
    within = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    if not offsets:
        return numbered.select(*columns, F.lit(0).cast("bigint").alias(name))
    offset_of = F.create_map(*[F.lit(x) for pair in offsets for x in pair])
    return numbered.select(*columns, (offset_of[part] + within).cast("bigint").alias(name))


def chunks(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Cut a batch into runs of rows whose sizes add up to ``most`` at the most, or of one row."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)
