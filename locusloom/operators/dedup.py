"""One row per key, chosen by an aggregate.

An aggregate combines copies of a key before the shuffle, so a key that holds a large share
of all rows reaches its reducer as one row per map task. A ranking window would not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def apart(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    """The frame with a hash of its keys, and the keys with that hash, to group by.

    An aggregate by plain keys leaves rows partitioned just as a join on them wants, and the
    join then reads them without a shuffle of its own. That is the wrong saving when the other
    side has hot keys: Spark splits a skewed partition only where both sides come straight from
    a shuffle. Grouped by one more, derived key the (short) rows are shuffled once more.
    """
    return df.withColumn("_apart", F.xxhash64(*keys)), [*keys, "_apart"]


def last_wins(
    df: DataFrame, keys: list[str], order: list[str], payload: list[str] | None = None, for_join: bool = False,
) -> DataFrame:
    """The row with the greatest ``order`` per key; the payload itself breaks ties.

    Returns keys and payload (all other columns when not given). ``for_join`` lets a join with
    the result split its skewed partitions, see ``apart``.
    """
    payload = payload or [c for c in df.columns if c not in keys and c not in order]
    rows, by = apart(df, keys) if for_join else (df, keys)
    best = rows.groupBy(*by).agg(F.max(F.struct(*order, *payload)).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in payload])


def best_quality(df: DataFrame, keys: list[str], quality: str, ties: list[str]) -> DataFrame:
    """The row with the highest quality per key (unknown last), then the smallest ``ties``."""
    rest = [c for c in df.columns if c not in keys and c != quality and c not in ties]
    ranked = F.struct(
        F.col(quality).isNull().alias("_unknown"), (-F.col(quality)).alias("_down"),
        *ties, *rest, F.col(quality),
    )
    best = df.groupBy(*keys).agg(F.min(ranked).alias("_best"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_best.{c}").alias(c) for c in df.columns])
