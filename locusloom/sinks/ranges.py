"""Rows in ranges of their place, also where one place holds very many of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusloom.schemas import SITE_KEY

NUMBER = "_number"
#: Rows of one range, and the rows below which a table is not dealt to more of them.
RANGE_ROWS, FEW_ROWS = 1 << 15, 1 << 10


def place_keys(df: DataFrame) -> list[str]:
    """The columns that order rows by place, as far as the frame has them."""
    return [c for c in (*SITE_KEY, "rsid") if c in df.columns]


def numbered(df: DataFrame) -> DataFrame:
    """A staged frame with a number of its own for each row.

    As the last key of a range it splits rows that agree in all others. The scan of a written table deals its rows the
    same way each time, so a repeated task finds the numbers of the first attempt.
    """
    return df.withColumn(NUMBER, F.monotonically_increasing_id())


def range_count(staged: DataFrame) -> int:
    """Ranges for a staged frame, by its rows: what one task sorts and writes does not grow with the table.

    Spark's own number follows the compressed bytes of the shuffle, which are few where rows are wide and alike.
    """
    rows, parts = staged.count(), int(staged.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(-(-rows // RANGE_ROWS), min(parts, -(-rows // FEW_ROWS)), 1)


def in_ranges(staged: DataFrame, keys: list[str]) -> DataFrame:
    """Rows dealt to ranges of the keys and sorted by them inside.

    Rows that share all keys may lie in several ranges, which then follow each other.
    """
    return numbered(staged).repartitionByRange(range_count(staged), *keys, NUMBER).sortWithinPartitions(*keys, NUMBER).drop(NUMBER)
