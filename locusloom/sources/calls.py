"""Array genotype calls: tab-separated rsid, chromosome, position, genotype."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusloom.functions.numeric import parse_position
from locusloom.schemas import AUTOSOMES
from locusloom.sources.lines import LINE_ORDER, read_lines, with_line_numbers

AUTOSOME_NAMES = [str(n) for n in AUTOSOMES]


class CallsFormatError(ValueError):
    """A calls file is empty or has a line that cannot be read."""


def parse_call_lines(lines: DataFrame) -> DataFrame:
    """Add rsid, chromosome, position, genotype and ``error`` to a frame with ``value``.

    Blank and ``#`` lines are left out. ``error`` is NULL on a good line.
    """
    trimmed = F.trim("value", F.lit(" \t\r"))
    fields = F.split(F.rtrim("value", F.lit("\r")), "\t")
    kept = lines.filter((trimmed != "") & ~trimmed.startswith("#")).withColumn("_f", fields)
    four = F.size("_f") == 4

    def field(i: int):
        return F.when(four, F.trim(F.col("_f")[i]))

    position = parse_position(field(2))
    return kept.select(
        *[c for c in lines.columns],
        field(0).alias("rsid"), field(1).alias("chromosome"), position.alias("position"),
        field(3).alias("genotype"),
        F.when(~four, F.concat(F.lit("expected 4 fields, found "), F.size("_f").cast("string")))
        .when(position.isNull(), F.concat(F.lit("invalid position "), field(2))).alias("error"),
    )


def keep_chromosomes(calls: DataFrame, chromosomes: list[str] | None) -> DataFrame:
    """Rows whose chromosome text is listed; ``None`` keeps all."""
    return calls if not chromosomes else calls.filter(F.col("chromosome").isin(list(chromosomes)))


def read_calls(
    spark: SparkSession, paths: str | list[str], chromosomes: list[str] | None = None, strict: bool = True,
) -> DataFrame:
    """Calls of one or more files with their line order columns.

    ``strict`` first runs one aggregate over the files and raises on the first bad line or
    when no line is left after the chromosome filter; otherwise bad lines are dropped.
    """
    lines = read_lines(spark, paths)
    parsed = parse_call_lines(lines)
    if strict:
        check_calls(parsed, chromosomes)
    good = parsed.filter(F.col("error").isNull())
    return keep_chromosomes(good.select("rsid", "chromosome", "position", "genotype", *LINE_ORDER), chromosomes)


def check_calls(parsed: DataFrame, chromosomes: list[str] | None = None) -> None:
    ok = F.col("error").isNull()
    kept = ok if not chromosomes else ok & F.col("chromosome").isin(list(chromosomes))
    place = F.struct(*LINE_ORDER)
    row = parsed.agg(
        F.count_if(kept).alias("kept"),
        F.min(F.when(~ok, F.struct(*LINE_ORDER, "error"))).alias("bad"),
    ).first()
    if row.bad is not None:
        lines = parsed.sparkSession.read.text(row.bad.file_path).select(
            "value", F.col("_metadata.file_path").alias("file_path"),
            F.col("_metadata.file_block_start").alias("split_start"),
            F.monotonically_increasing_id().alias("row_id"),
        )
        first = parse_call_lines(with_line_numbers(lines)).filter(F.col("error").isNotNull()).orderBy(place).first()
        raise CallsFormatError(f"{first.file_path}: line {first.line_no}: {first.error}")
    if not row.kept:
        raise CallsFormatError("no calls found")
