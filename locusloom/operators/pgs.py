"""Polygenic scores: standardisation, statistics and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusloom.functions.numeric import normal_cdf, predicted_trait_value
from locusloom.operators.ranking import percent_rank
from locusloom.session import stage


def pgs_stats(scores: DataFrame, by: list[str] | None = None, ddof: int = 0) -> DataFrame:
    """Per label: n, mean, sd (population unless ``ddof=1``), min, max."""
    sd = F.stddev_samp("value") if ddof else F.stddev_pop("value")
    return scores.groupBy(*(by or ["label"])).agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), sd.alias("sd"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )


def _standardised(value: Column) -> Column:
    """(x - mean) / sd, 0 where all values are equal.

    Equal sums may differ in their last bits, so a spread below 1e-12 of the size is none.
    """
    size = F.greatest(F.abs("_min"), F.abs("_max"))
    varies = (F.col("_sd") > 0) & (F.col("_max") - F.col("_min") > size * F.lit(1e-12))
    return F.when(varies, (value - F.col("_mean")) / F.col("_sd")).otherwise(F.lit(0.0))


def _with_stats(scores: DataFrame, reference: DataFrame, ddof: int) -> DataFrame:
    stats = pgs_stats(reference, ["label"], ddof).select(
        "label", F.col("mean").alias("_mean"), F.col("sd").alias("_sd"),
        F.col("min").alias("_min"), F.col("max").alias("_max"),
    )
    return scores.join(stage(stats, "label-stats"), "label", "left")


def scale_pgs(scores: DataFrame, ddof: int = 0) -> DataFrame:
    """Add ``z``, the score standardised within its label.

    Like a scaler's fit and transform: the statistics are aggregated and staged first, then
    joined back. The scores are scanned twice and never shuffled while the statistics are
    small; a label with most of the rows is neither sorted nor held in one task.
    """
    return _with_stats(scores, scores, ddof).withColumn("z", _standardised(F.col("value"))).drop(
        "_mean", "_sd", "_min", "_max")


def normalise_to_reference(scores: DataFrame, is_reference: Column, ddof: int = 0) -> DataFrame:
    """Add ``z`` by the mean and sd of the reference rows only."""
    return _with_stats(scores, scores.filter(is_reference), ddof).withColumn(
        "z", _standardised(F.col("value"))).drop("_mean", "_sd", "_min", "_max")


def trait_labels(scores: DataFrame) -> DataFrame:
    """Distinct labels."""
    return scores.select("label").distinct()


def trait_count(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count_distinct("label").alias("traits"))


def pgs_output(scored: DataFrame, scaled: bool) -> DataFrame:
    """Sink form: sample_id, trait_label, value (raw or standardised)."""
    value = F.col("z") if scaled else F.col("value")
    return scored.select("sample_id", F.col("label").alias("trait_label"), value.alias("value"))


def pivot_scores(scored: DataFrame, sample_ids: list[str], column: str = "value") -> DataFrame:
    """One row per label, one column per listed sample."""
    return scored.groupBy("label").pivot("sample_id", sample_ids).agg(F.max(column))


def pivot_traits(scores: DataFrame, labels: list[str]) -> DataFrame:
    """One row per sample, one column per listed label: the wide score form."""
    return scores.groupBy(F.col("sample_id").alias("sample")).pivot("label", labels).agg(F.max("value"))


def score_percentile(scores: DataFrame) -> DataFrame:
    """Add ``percentile``: percent rank of the score within its label, 0 to 100."""
    return percent_rank(scores, ["label"], "value")


def normal_percentile(scored: DataFrame) -> DataFrame:
    """Add ``percentile`` from the normal distribution of ``z``."""
    return scored.withColumn("percentile", normal_cdf("z") * 100.0)


def predict_trait(scored: DataFrame, models: DataFrame) -> DataFrame:
    """Add ``predicted`` from per-label ``r2``, ``trait_sd`` and ``trait_mean``."""
    return scored.join(models, "label").withColumn(
        "predicted", predicted_trait_value("r2", "z", "trait_sd", "trait_mean"))
