"""Imputed-dosage VCF text to rows, with an error column and a per-file error budget."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusloom.functions.genotype import vcf_chromosome
from locusloom.functions.numeric import NUMBER_PATTERN, parse_double, parse_position
from locusloom.schemas import IMPUTED_ROWS
from locusloom.session import stage
from locusloom.sources.blocks import read_block_lines
from locusloom.sources.lines import LINE_ORDER, read_lines

DEFAULT_MAX_ERRORS = 1000


class VcfErrorBudgetExceeded(ValueError):
    """A VCF file has more unreadable lines than allowed."""


def info_quality(info: Column, tags: tuple[str, ...] = ("R2",)) -> Column:
    """First item ``TAG=number`` of INFO, for the first tag that has one; NULL if none has.

    The pattern takes numbers only, so an item that is none is passed over for a later one.
    """
    number = NUMBER_PATTERN.strip("^$").replace("(", "(?:")

    def first_number(tag: str) -> Column:
        text = F.regexp_extract(info, rf"(?:^|;){re.escape(tag)}=({number})(?:;|$)", 1)
        return F.when(text != "", text.cast("double"))

    return F.coalesce(*[first_number(t) for t in tags])


def parse_vcf_lines(lines: DataFrame, quality_tags: tuple[str, ...] = ("R2",)) -> DataFrame:
    """Add the imputed-row columns and ``error`` to a frame with ``value``; header lines go.

    The dosage is the DS entry of the last sample column. Parts that several columns need are
    projected first, and the columns are made in a row that is then exploded, as Spark would otherwise
    push a filter on ``error`` down into the lines and split each one again for every use of a part.
    """
    body = lines.filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    body = body.withColumn("_f", F.split(F.rtrim("value", F.lit("\r")), "\t"))
    f = [F.get("_f", F.lit(i)) for i in range(9)]
    chrom, pos, ident, ref, alts, info, fmt = f[0], f[1], f[2], f[3], f[4], f[7], f[8]
    kept = [F.col(c) for c in lines.columns]

    cells = body.select(
        *kept, vcf_chromosome(chrom).alias("chromosome"), parse_position(pos).alias("position"), ident.alias("_id"),
        ref.alias("ref_allele"),
        F.when((alts != ".") & (alts != ""), F.substring_index(alts, ",", 1)).alias("alt_allele"),
        info_quality(info, quality_tags).alias("imputation_quality"),
        F.array_position(F.split(fmt, ":"), "DS").cast("int").alias("_ds"),
        F.when(F.size("_f") >= 10, F.split(F.element_at("_f", -1), ":")).alias("_cell"),
    )
    texts = cells.withColumn("_text", F.when(F.col("_ds") > 0, F.get("_cell", F.col("_ds") - 1)))
    parsed = texts.withColumn("dosage", parse_double("_text"))
    position = F.col("position")
    error = (
        F.when(F.col("chromosome").isNull(), F.lit("invalid chromosome"))
        .when(position.isNull() | (position < 1), F.lit("invalid position"))
        .when(F.col("alt_allele").isNull(), F.lit("missing ALT"))
        .when(F.col("_cell").isNull(), F.lit("no sample column"))
        .when(F.coalesce("_ds", F.lit(0)) == 0, F.lit("no DS in FORMAT"))
        .when(F.col("_text").isNull(), F.lit("no DS in sample"))
        .when(F.col("dosage").isNull(), F.lit("invalid DS"))
        .when(~F.col("dosage").between(0.0, 2.0), F.lit("DS out of range"))
    )
    made_up = F.concat(
        F.lit("chr"), F.col("chromosome").cast("string"), F.lit(":"), position.cast("string"), F.lit(":"),
        F.col("ref_allele"), F.lit(":"), F.col("alt_allele"))
    no_id = F.col("_id").isNull() | F.col("_id").isin(".", "")
    columns = F.struct(
        F.when(no_id, made_up).otherwise(F.substring_index("_id", ";", 1)).alias("rsid"), "chromosome", "position",
        "ref_allele", "alt_allele", "dosage", "imputation_quality", error.alias("error"))
    return parsed.select(*kept, F.inline(F.array(columns)))


def filter_min_quality(imputed: DataFrame, min_quality: float | None) -> DataFrame:
    """Drop rows with a quality below the minimum; unknown quality stays."""
    if not min_quality:
        return imputed
    q = F.col("imputation_quality")
    return imputed.filter(q.isNull() | (q >= float(min_quality)))


def file_report(parsed: DataFrame, min_quality: float | None = None) -> DataFrame:
    """Rows, errors and quality-skipped rows per file."""
    bad = F.col("error").isNotNull()
    low = ~bad & (F.col("imputation_quality") < F.lit(float(min_quality or 0.0)))
    return parsed.groupBy("file_path").agg(
        F.count("*").alias("data_rows"), F.count_if(bad).alias("error_rows"),
        F.count_if(low).alias("skipped_rows"),
    )


@dataclass
class VcfRead:
    """Staged result of one read: good rows, rejected lines and counts per file."""

    rows: DataFrame
    rejects: DataFrame
    report: DataFrame


def read_vcf(
    spark: SparkSession, paths: str | list[str], min_quality: float | None = None,
    max_errors: int = DEFAULT_MAX_ERRORS, quality_tags: tuple[str, ...] = ("R2",),
    lines: Callable[[SparkSession, str | list[str]], DataFrame] = read_block_lines,
) -> VcfRead:
    """Parse once into a table in the shared folder, check the budget there, then serve from it.

    Block-compressed and plain text is read by many tasks a file. Plain gzip can't be split: its
    one task a file ends in the staged table, which is.
    """
    columns = [*IMPUTED_ROWS.fieldNames(), *LINE_ORDER]
    parsed = parse_vcf_lines(lines(spark, paths), quality_tags)
    text = F.when(F.col("error").isNotNull(), F.col("value")).alias("value")
    staged = stage(parsed.select(*columns, "error", text), "imputed")
    report = file_report(staged, min_quality)
    over = report.filter(F.col("error_rows") > max_errors).orderBy("file_path").first()
    if over is not None:
        raise VcfErrorBudgetExceeded(f"{over.file_path}: {over.error_rows} errors > {max_errors}")
    good = staged.filter(F.col("error").isNull()).select(*columns)
    rejects = staged.filter(F.col("error").isNotNull()).select(*LINE_ORDER, "value", "error")
    return VcfRead(filter_min_quality(good, min_quality), rejects, report)


def scan_vcf(spark: SparkSession, paths: str | list[str], quality_tags: tuple[str, ...] = ("R2",)) -> DataFrame:
    """Lazy read without a budget: good rows only."""
    parsed = parse_vcf_lines(read_lines(spark, paths), quality_tags)
    return parsed.filter(F.col("error").isNull()).select(*IMPUTED_ROWS.fieldNames(), *LINE_ORDER)


def profile_vcf_lines(lines: DataFrame) -> DataFrame:
    """One row: data and header lines, mean dosage, and count, share, mean and range of R2."""
    header = lines.agg(F.count_if(F.col("value").startswith("#")).alias("header_rows"))
    good = F.col("error").isNull()
    q = F.when(good, F.col("imputation_quality"))
    body = parse_vcf_lines(lines).agg(
        F.count("*").alias("data_rows"), F.count_if(~good).alias("error_rows"),
        F.avg(F.when(good, F.col("dosage"))).alias("mean_dosage"),
        F.count(q).alias("quality_rows"), F.avg(q).alias("mean_quality"),
        F.min(q).alias("min_quality"), F.max(q).alias("max_quality"),
        (F.count(q) / F.greatest(F.count("*"), F.lit(1))).alias("quality_share"),
    )
    # Two one-row aggregates, put side by side through a constant key.
    return body.withColumn("_k", F.lit(1)).join(
        F.broadcast(header.withColumn("_k", F.lit(1))), "_k"
    ).drop("_k")
