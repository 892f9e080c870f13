"""Schemas of the frames that pass between operators."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _D, _B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()

AUTOSOMES = range(1, 23)
PANEL_SAMPLES = 50
USER_SAMPLE = "samp51"

GENOTYPED = "Genotyped"
IMPUTED = "Imputed"
IMPUTED_LOW = "ImputedLowQual"
LOW_QUALITY_R2 = 0.3

SITE_KEY = ["chromosome", "position", "ref_allele", "alt_allele"]

CALLS = T.StructType([
    T.StructField("rsid", _S), T.StructField("chromosome", _S),
    T.StructField("position", _L), T.StructField("genotype", _S),
])

IMPUTED_ROWS = T.StructType([
    T.StructField("rsid", _S), T.StructField("chromosome", _I), T.StructField("position", _L),
    T.StructField("ref_allele", _S), T.StructField("alt_allele", _S),
    T.StructField("dosage", _D), T.StructField("imputation_quality", _D),
])

PANEL = T.StructType([
    T.StructField("chromosome", _I), T.StructField("position", _L), T.StructField("rsid", _S),
    T.StructField("ref_allele", _S), T.StructField("alt_allele", _S), T.StructField("phased", _B),
    T.StructField("allele_freq", _D), T.StructField("minor_allele_freq", _D),
    T.StructField("imputation_quality", _D), T.StructField("is_typed", _B),
    T.StructField("sample_genotypes", T.ArrayType(_S)),
])

PGS = T.StructType([
    T.StructField("sample_id", _S), T.StructField("label", _S), T.StructField("value", _D),
])

SAMPLE = T.StructType([
    T.StructField("sample_id", _S), T.StructField("genotype", _S), T.StructField("dosage", _D),
    T.StructField("source", _S), T.StructField("imputation_quality", _D),
])

# Column order of the long table, one row per variant and sample.
LONG_COLUMNS = [
    "rsid", "chromosome", "position", "ref_allele", "alt_allele", "allele_freq",
    "minor_allele_freq", "is_typed", "sample_id", "genotype", "dosage", "source",
    "imputation_quality",
]

SINGLE_COLUMNS = [
    "rsid", "chromosome", "position", "ref_allele", "alt_allele", "dosage", "source",
    "imputation_quality",
]

AUDIT = T.StructType([
    T.StructField("id", _S), T.StructField("timestamp", T.TimestampType()),
    T.StructField("event_type", _S), T.StructField("user_id", _S), T.StructField("action", _S),
    T.StructField("result", _S), T.StructField("details", _S), T.StructField("severity", _S),
])

ATTEMPTS = T.StructType([
    T.StructField("id", _S), T.StructField("job_id", _S), T.StructField("attempted_at", T.TimestampType()),
    T.StructField("ip_address", _S), T.StructField("user_agent", _S),
    T.StructField("password_valid", _B), T.StructField("attempt_result", _S),
])

PROGRESS = T.StructType([
    T.StructField("job_id", _S), T.StructField("progress_pct", _D),
    T.StructField("message", _S), T.StructField("timestamp", T.TimestampType()),
])
