"""Look-ups, region queries and exports over merged and long frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusloom.functions.genotype import is_identifier, display_call, is_heterozygous, is_snp, passes_quality
from locusloom.operators.dedup import apart, best_quality
from locusloom.schemas import GENOTYPED


def lookup_rsid(calls: DataFrame, rsids: list[str]) -> DataFrame:
    """Calls of the given identifiers with a heterozygosity flag."""
    return calls.filter(F.col("rsid").isin(list(rsids))).withColumn(
        "is_heterozygous", F.coalesce(is_heterozygous("genotype"), F.lit(False)))


def high_dosage(long: DataFrame, sample_id: str, minimum: float = 1.5) -> DataFrame:
    return long.filter((F.col("sample_id") == sample_id) & (F.col("dosage") > minimum))


def rare_variants(df: DataFrame, maximum: float = 0.01) -> DataFrame:
    return df.filter(F.col("allele_freq") < maximum)


def region(
    merged: DataFrame, chromosome: int, start: int, end: int,
    min_quality: float | None = None, only_genotyped: bool = False,
) -> DataFrame:
    """Variants of [start, end] on one chromosome; the place filter reaches the scan."""
    rows = merged.filter((F.col("chromosome") == chromosome) & F.col("position").between(start, end))
    rows = rows.filter(passes_quality("user_quality", min_quality))
    return rows.filter(F.col("user_source") == GENOTYPED) if only_genotyped else rows


def page(df: DataFrame, order: list[str], number: int, size: int = 100) -> DataFrame:
    """One page with the ``total_count`` of all rows."""
    total = df.agg(F.count("*").alias("total_count"), F.lit(1).alias("_k"))
    rows = df.orderBy(*order).offset((number - 1) * size).limit(size).withColumn("_k", F.lit(1))
    return rows.join(F.broadcast(total), "_k").drop("_k")


def preview(df: DataFrame, rows: int = 10) -> DataFrame:
    return df.limit(rows)


def filtered_export(
    df: DataFrame, chromosomes: list[int] | None = None, min_quality: float | None = None,
    only_genotyped: bool = False, quality: str = "imputation_quality", source: str = "source",
) -> DataFrame:
    """Rows by chromosome list, minimum quality and source, for any of the sinks."""
    if chromosomes:
        df = df.filter(F.col("chromosome").isin(list(chromosomes)))
    df = df.filter(passes_quality(quality, min_quality))
    return df.filter(F.col(source) == GENOTYPED) if only_genotyped else df


def wide_genotypes(merged: DataFrame) -> DataFrame:
    """Ten site columns and one genotype column per sample, samp1..samp51."""
    cells = F.concat("sample_genotypes", F.array("user_genotype"))
    rows = merged.withColumn("_cells", cells)
    return rows.select(
        "rsid", "chromosome", "position", "ref_allele", "alt_allele", "allele_freq", "minor_allele_freq",
        "is_typed", "panel_quality", "user_source",
        *[F.try_element_at("_cells", F.lit(i)).alias(f"samp{i}") for i in range(1, 52)],
    )


def biallelic_snps(merged: DataFrame) -> DataFrame:
    return merged.filter(is_snp("ref_allele", "alt_allele") & F.col("chromosome").between(1, 22))


def best_per_rsid(imputed: DataFrame) -> DataFrame:
    """The row with the best R2 per identifier."""
    return best_quality(imputed, ["rsid"], "imputation_quality", ["chromosome", "position", "ref_allele", "alt_allele"])


def annotate_calls(calls: DataFrame, panel: DataFrame) -> DataFrame:
    """Calls with the panel's alleles and minor allele frequency by identifier.

    Of several panel rows with one identifier the first by place is used.
    """
    rows, by = apart(panel.filter(is_identifier("rsid")), ["rsid"])
    sites = rows.groupBy(*by).agg(
        F.min(F.struct("chromosome", "position", "ref_allele", "alt_allele", "minor_allele_freq")).alias("_s"))
    sites = sites.select(
        "rsid", F.col("_s.ref_allele").alias("ref_allele"), F.col("_s.alt_allele").alias("alt_allele"),
        F.col("_s.minor_allele_freq").alias("minor_allele_freq"))
    return calls.join(sites, "rsid", "left").withColumn("display", display_call("genotype", "ref_allele", "alt_allele"))


def rows_of_user(df: DataFrame, user_id: str, column: str = "user_id") -> DataFrame:
    """Only the user's own rows, as the access policy has it."""
    return df.filter(F.col(column) == user_id)


def genotypes_of_user(genotypes: DataFrame, samples: DataFrame, user_id: str) -> DataFrame:
    """Genotype rows whose sample belongs to the user."""
    return genotypes.join(rows_of_user(samples, user_id).select("sample_id"), "sample_id", "left_semi")
