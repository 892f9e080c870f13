"""Text lines with a total order inside each file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Columns that order lines as they stand in the files. ``row_id`` grows inside one input
# split only, so the split's start has to come before it.
LINE_ORDER = ["file_path", "split_start", "row_id"]


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """value, file_path, split_start, row_id for plain or gzip text.

    A gzip file, also one of many members, is one split.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.text(paths).select(
        "value",
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("split_start"),
        F.monotonically_increasing_id().alias("row_id"),
    )


def with_line_numbers(lines: DataFrame) -> DataFrame:
    """Add the 1-based ``line_no`` within the file.

    Row ids are consecutive inside a split, so a line's number is the number of lines in the
    file's earlier splits plus its distance from the split's first id. Only one row per split
    is summed up; the lines themselves are not sorted or moved.
    """
    in_file = W.partitionBy("file_path").orderBy("split_start").rowsBetween(W.unboundedPreceding, -1)
    earlier = lines.groupBy("file_path", "split_start").agg(
        F.min("row_id").alias("_first"), F.count("*").alias("_n"),
    ).withColumn("_before", F.coalesce(F.sum("_n").over(in_file), F.lit(0))).drop("_n")
    return lines.join(earlier, ["file_path", "split_start"]).withColumn(
        "line_no", F.col("row_id") - F.col("_first") + F.col("_before") + 1
    ).drop("_first", "_before")
