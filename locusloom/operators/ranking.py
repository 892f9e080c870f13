"""Exact ranks and quantiles in groups of any size.

A plain ranking window sorts a whole group in one task. Here a group's rows are first counted by value, in one scan of
the input; the counts are then dealt to ranges of (group, value), as many as their number asks for, and each range is ranked on
its own and offset by the exact number of rows in the group's ranges below it. The ranges only decide who does the work,
never the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locusloom.session import stage

#: Distinct values in one range, about.
RANGE_VALUES = 200_000


def value_counts(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Per group and distinct value (not null): ``n`` rows. One scan of the input; the counts are staged, as they are read several times."""
    rows = df.filter(F.col(value).isNotNull()).select(*by, value)
    return stage(rows.groupBy(*by, value).agg(F.count("*").alias("n")), "value-counts")


def _join_alike(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys where null equals null, as it does in a group."""
    other = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    alike = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(other, alike).drop(*[f"_right_{k}" for k in keys])


def ranked_counts(counts: DataFrame, by: list[str], value: str, ranges: int | None = None) -> DataFrame:
    """Staged ``value_counts`` with ``below`` rows of a smaller value and ``total`` rows of the group.

    ``ranges``: their number, by default from the number of distinct values.
    """
    ranges = ranges or -(-counts.count() // RANGE_VALUES)
    ranged = counts.withColumn("_range", F.lit(0))
    if ranges > 1:
        dealt = counts.repartitionByRange(ranges, *by, value)
        ranged = stage(dealt.withColumn("_range", F.spark_partition_id()), "value-ranges")
    sizes = ranged.groupBy(*by, "_range").agg(F.sum("n").alias("_in_range"))
    group = W.partitionBy(*by)
    sizes = sizes.select(
        *by, "_range",
        F.coalesce(F.sum("_in_range").over(group.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_in_range").over(group).alias("total"),
    )
    inside = W.partitionBy(*by, "_range").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    ranked = ranged.withColumn("_inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return _join_alike(ranked, sizes, [*by, "_range"]).select(
        *by, value, "n", (F.col("_before") + F.col("_inside")).alias("below"), "total",
    )


def cumulative_counts(df: DataFrame, by: list[str], value: str, ranges: int | None = None) -> DataFrame:
    """Per group and distinct value: ``n`` rows, ``below`` rows with a smaller value, ``total`` rows."""
    return ranked_counts(value_counts(df, by, value), by, value, ranges)


def percent_rank(df: DataFrame, by: list[str], value: str, name: str = "percentile") -> DataFrame:
    """Rows with ``100 * (rank - 1) / (rows - 1)`` inside their group; a single row gets 0."""
    ranks = cumulative_counts(df, by, value).select(
        *by, value,
        F.when(F.col("total") > 1, F.col("below") * 100.0 / (F.col("total") - 1)).otherwise(F.lit(0.0)).alias(name),
    )
    return df.join(ranks, [*by, value], "left")


def quantiles(df: DataFrame, by: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation, one named column each."""
    return quantiles_of_counts(value_counts(df, by, value), by, value, probs)


def quantiles_of_counts(counts: DataFrame, by: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """``quantiles`` from staged ``value_counts``."""
    ranked = ranked_counts(counts, by, value)
    last = F.col("total") - 1

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("below") <= rank) & (rank < F.col("below") + F.col("n")), F.col(value)))

    parts = []
    for name, p in probs.items():
        h = last * F.lit(float(p))
        low = F.floor(h)
        parts += [
            at(low).alias(f"_lo_{name}"), at(F.least(low + 1, last)).alias(f"_hi_{name}"),
            F.max(h - low).alias(f"_f_{name}"),
        ]
    out = ranked.groupBy(*by).agg(*parts)
    return out.select(*by, *[
        (F.col(f"_lo_{n}") + F.col(f"_f_{n}") * (F.col(f"_hi_{n}") - F.col(f"_lo_{n}"))).alias(n) for n in probs
    ])


def describe_counts(counts: DataFrame, by: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """count, mean, sd (n-1), min, max and quantiles of staged ``value_counts``; the input is not read again.

    Squares are summed around the group's mean, so large values with a small spread lose nothing.
    """
    v, n = F.col(value), F.col("n")
    totals = counts.groupBy(*by).agg(
        F.sum("n").alias("count"), (F.sum(v * n) / F.sum("n")).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"))
    around = _join_alike(counts, totals.select(*by, "mean", "count"), by)
    spread = around.groupBy(*by).agg(F.sqrt(F.try_divide(
        F.sum(n * (v - F.col("mean")) * (v - F.col("mean"))), F.max("count") - 1)).alias("sd"))
    parts = _join_alike(_join_alike(totals, spread, by), quantiles_of_counts(counts, by, value, probs), by)
    return parts.select(*by, "count", "mean", "sd", "min", "max", *probs)
