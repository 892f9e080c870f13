"""Reference panel tables: one row per variant with the genotypes of 50 samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusloom.functions.text import array_to_sample_map, sample_map_to_array
from locusloom.schemas import AUTOSOMES, PANEL, PANEL_SAMPLES

# Site columns as wide source frames name them -> panel column.
WIDE_NAMES = {
    "bp37": "position", "rsid": "rsid", "REF": "ref_allele", "ALT": "alt_allele", "PHASED": "phased",
    "AF": "allele_freq", "MAF": "minor_allele_freq", "R2": "imputation_quality", "TYPED": "is_typed",
}


class PanelError(ValueError):
    """The panel lacks a table, a column or a sample."""


def panel_from_stored(stored: DataFrame, samples: int = PANEL_SAMPLES) -> DataFrame:
    """Stored form (genotypes as a JSON object, flags as 0/1) to the panel schema."""
    genotypes = F.col("sample_genotypes")
    if dict(stored.dtypes)["sample_genotypes"] == "string":
        genotypes = sample_map_to_array(genotypes, samples)
    return stored.select(
        F.col("chromosome").cast("int").alias("chromosome"), F.col("position").cast("bigint").alias("position"),
        "rsid", "ref_allele", "alt_allele",
        F.coalesce(F.col("phased").cast("boolean"), F.lit(False)).alias("phased"),
        "allele_freq", "minor_allele_freq", "imputation_quality",
        F.coalesce(F.col("is_typed").cast("boolean"), F.lit(False)).alias("is_typed"),
        genotypes.alias("sample_genotypes"),
    )


def panel_to_stored(panel: DataFrame) -> DataFrame:
    """Panel schema to the stored form."""
    return panel.withColumns({
        "phased": F.col("phased").cast("int"), "is_typed": F.col("is_typed").cast("int"),
        "sample_genotypes": array_to_sample_map("sample_genotypes"),
    })


def read_panel(spark: SparkSession, path: str, chromosomes: list[int] | None = None, check: bool = True) -> DataFrame:
    """Parquet panel, whole or some chromosomes; a missing sample is an error.

    The check rides on the rows (``raise_error`` in the projection), so it needs no extra pass.
    """
    stored = spark.read.parquet(path)
    if chromosomes is not None:
        stored = stored.filter(F.col("chromosome").isin(list(chromosomes)))
    panel = panel_from_stored(stored)
    if not check:
        return panel
    g = F.col("sample_genotypes")
    whole = g.isNotNull() & (F.size(g) == PANEL_SAMPLES) & ~F.coalesce(F.array_contains(F.transform(g, lambda x: x.isNull()), True), F.lit(False))
    message = F.concat(F.lit("panel sample missing at "), F.col("chromosome").cast("string"), F.lit(":"), F.col("position").cast("string"))
    return panel.withColumn("sample_genotypes", F.when(whole, g).otherwise(F.raise_error(message).cast("array<string>")))


def chromosome_variants(panel: DataFrame, chromosome: int) -> DataFrame:
    """One chromosome by position; the filter prunes partitions."""
    return panel.filter(F.col("chromosome") == chromosome).orderBy("position", "ref_allele", "alt_allele")


def panel_metadata(metadata: DataFrame, key: str) -> DataFrame:
    return metadata.filter(F.col("key") == key).select("key", "value")


def panel_counts(panel: DataFrame) -> DataFrame:
    return panel.groupBy("chromosome").agg(F.count("*").alias("variants"))


def panel_total(panel: DataFrame) -> DataFrame:
    return panel.agg(F.count("*").alias("variants"))


def validate_panel(panel: DataFrame, metadata: DataFrame) -> DataFrame:
    """One row per check: columns present, variants and metadata countable."""
    missing = sorted(set(PANEL.fieldNames()) - set(panel.columns))
    if missing:
        raise PanelError(f"panel lacks columns {missing}")
    if not {"key", "value"} <= set(metadata.columns):
        raise PanelError("metadata lacks columns key, value")
    variants = panel.agg(F.lit("variants").alias("table_name"), F.count("*").alias("row_count"))
    keys = metadata.agg(F.lit("metadata").alias("table_name"), F.count("*").alias("row_count"))
    return variants.unionByName(keys)


def nest_wide(wide: DataFrame, samples: int = PANEL_SAMPLES) -> DataFrame:
    """Wide rows with a chromosome and columns samp1..sampN to the panel schema."""
    named = wide.withColumnsRenamed({k: v for k, v in WIDE_NAMES.items() if k in wide.columns})
    return named.select(
        F.col("chromosome").cast("int").alias("chromosome"), F.col("position").cast("bigint").alias("position"),
        "rsid", "ref_allele", "alt_allele", F.col("phased").cast("int").cast("boolean").alias("phased"),
        *[F.col(c).cast("double").alias(c) for c in ("allele_freq", "minor_allele_freq", "imputation_quality")],
        F.col("is_typed").cast("int").cast("boolean").alias("is_typed"),
        F.array(*[F.col(f"samp{i}") for i in range(1, samples + 1)]).alias("sample_genotypes"),
    )


def build_panel(frames: dict[int, DataFrame], samples: int = PANEL_SAMPLES) -> DataFrame:
    """One wide frame per chromosome, without the chromosome, to one panel frame."""
    named = [f.withColumn("chromosome", F.lit(c)) for c, f in sorted(frames.items())]
    return nest_wide(reduce(DataFrame.unionByName, named), samples)


def missing_chromosomes(frame: DataFrame) -> DataFrame:
    """Autosomes without a row."""
    expected = frame.sparkSession.range(AUTOSOMES.start, AUTOSOMES.stop).select(F.col("id").cast("int").alias("chromosome"))
    return expected.join(frame.select("chromosome").distinct(), "chromosome", "left_anti")
