"""Polygenic score tables (one score per sample and trait) and weight tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locusloom.functions.genotype import vcf_chromosome
from locusloom.functions.numeric import is_finite, parse_double


class PgsFormatError(ValueError):
    """A score file is empty or has a value that is no finite number."""


def _strip_quotes(text: Column) -> Column:
    return F.regexp_replace(text, r'^"+|"+$', "")


def long_scores(rows: DataFrame) -> DataFrame:
    """Text columns ID, PGS_label, score_value to sample_id, label, value, error."""
    value = parse_double(F.col("score_value"))
    return rows.select(
        F.col("ID").alias("sample_id"), F.col("PGS_label").alias("label"), value.alias("value"),
        F.when(~is_finite(value), F.concat(F.lit("invalid value "), F.coalesce("score_value", F.lit("")))).alias("error"),
    )


def wide_scores(rows: DataFrame) -> DataFrame:
    """First column the sample, then one text column per trait, to sample_id, label, value, error."""
    sample, *traits = rows.columns
    clean = rows.select(
        _strip_quotes(F.col(f"`{sample}`").cast("string")).alias("sample_id"),
        *[F.col(f"`{t}`").cast("string").alias(t.strip('"')) for t in traits],
    )
    names = [t.strip('"') for t in traits]
    # unpivot drops nothing: a missing cell arrives as NULL and is an error.
    tall = clean.unpivot("sample_id", [F.col(f"`{n}`") for n in names], "label", "text")
    value = parse_double(_strip_quotes(F.col("text")))
    return tall.select(
        "sample_id", "label", value.alias("value"),
        F.when(~is_finite(value), F.concat(F.lit("invalid value "), F.coalesce("text", F.lit("")))).alias("error"),
    )


def is_wide_header(first_cell: str) -> bool:
    return first_cell in ("sample", '"sample"')


def read_pgs_scores(spark: SparkSession, path: str) -> DataFrame:
    """sample_id, label, value from a long or wide CSV, chosen by the first header cell.

    Any ragged row or value that is not a finite number fails the read.
    """
    header = spark.read.text(path).filter(F.trim("value") != "").first()
    if header is None:
        raise PgsFormatError("empty score file")
    names = [c.strip().strip('"') for c in header.value.split(",")]
    wide = is_wide_header(names[0])
    if not wide and not {"ID", "PGS_label", "score_value"} <= set(names):
        raise PgsFormatError(f"unknown score header {names}")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names] + [T.StructField("_corrupt", T.StringType())])
    rows = spark.read.csv(
        path, header=True, schema=schema, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt",
        enforceSchema=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True,
    )
    scores = (wide_scores(rows.drop("_corrupt")) if wide else long_scores(rows))
    # Reading every column keeps the ragged-row check alive under column pruning.
    check = scores.agg(F.count("*").alias("n"), F.min("error").alias("error")).first()
    ragged = rows.select(F.count("_corrupt").alias("n"), *[F.count(f"`{n}`") for n in names]).first()
    if ragged[0]:
        raise PgsFormatError(f"{ragged[0]} rows do not match the header")
    if check.error is not None:
        raise PgsFormatError(check.error)
    if not check.n:
        raise PgsFormatError("empty score file")
    return scores.drop("error")


def read_pgs_weights(spark: SparkSession, path: str, trait: str | None = None, sep: str = "\t") -> DataFrame:
    """Weight per site: rsid, chromosome, position, effect_allele, other_allele, weight (and trait).

    A leading ``chr`` is taken off; X and other places off the autosomes have no chromosome.
    """
    schema = "SNP string, CHR string, BP bigint, A1 string, A2 string, weight double"
    rows = spark.read.csv(path, header=True, sep=sep, schema=schema, mode="FAILFAST")
    return rows.select(
        F.lit(trait).cast("string").alias("trait"), F.col("SNP").alias("rsid"), vcf_chromosome("CHR").alias("chromosome"),
        F.col("BP").alias("position"), F.col("A1").alias("effect_allele"), F.col("A2").alias("other_allele"), "weight",
    )
