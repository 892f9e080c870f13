"""Counts and distributions over calls, imputed rows, panel and merged frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusloom.functions.genotype import genotype_text_dosage, is_heterozygous, is_snp
from locusloom.operators.ranking import describe_counts, value_counts
from locusloom.schemas import GENOTYPED, IMPUTED_LOW

_Q = "imputation_quality"


# -- merged frames ---------------------------------------------------------------------

def run_statistics(merged: DataFrame, by: list[str] | None = None) -> DataFrame:
    """total, genotyped (typed in the panel), imputed, low_quality (the person's value)."""
    typed = F.count_if(F.col("is_typed"))
    return merged.groupBy(*(by or [])).agg(
        F.count("*").alias("total"), typed.alias("genotyped"), (F.count("*") - typed).alias("imputed"),
        F.count_if(F.col("user_source") == IMPUTED_LOW).alias("low_quality"),
    )


def single_sample_statistics(merged: DataFrame) -> DataFrame:
    """total, genotyped, imputed, low_quality by the person's source."""
    source = F.col("source")
    return merged.agg(
        F.count("*").alias("total"), F.count_if(source == GENOTYPED).alias("genotyped"),
        F.count_if(source != GENOTYPED).alias("imputed"), F.count_if(source == IMPUTED_LOW).alias("low_quality"),
    )


def user_genotyped_counts(merged: DataFrame) -> DataFrame:
    """Variants and measured ones per chromosome, and in total with a NULL chromosome."""
    return merged.rollup("chromosome").agg(
        F.count("*").alias("variants"), F.count_if(F.col("user_source") == GENOTYPED).alias("user_genotyped"))


def ideogram_counts(merged: DataFrame, high: float = 0.8) -> DataFrame:
    """Per chromosome: measured variants and imputed ones of high and low quality."""
    measured = F.col("user_source") == GENOTYPED
    return merged.groupBy("chromosome").agg(
        F.count_if(measured).alias("genotyped"),
        F.count_if(~measured & (F.col("user_quality") >= high)).alias("imputed_high_quality"),
        F.count_if(~measured & ~F.coalesce(F.col("user_quality") >= high, F.lit(False))).alias("imputed_low_quality"),
    )


def genotyped_positions(merged: DataFrame, chromosome: int) -> DataFrame:
    return merged.filter((F.col("chromosome") == chromosome) & (F.col("user_source") == GENOTYPED)).select(
        "chromosome", "position", "rsid")


def sample_metrics(merged: DataFrame) -> DataFrame:
    """The person's genotyped, imputed and total counts and mean imputation quality."""
    measured = F.col("user_source") == GENOTYPED
    return merged.agg(
        F.count_if(measured).alias("snp_count_genotyped"), F.count_if(~measured).alias("snp_count_imputed"),
        F.count("*").alias("snp_count_total"), F.avg("user_quality").alias("mean_imputation_quality"),
    )


def match_metrics(merged: DataFrame, calls: DataFrame) -> DataFrame:
    """Per chromosome of the panel: variants, match rate, mean quality and quality tiers.

    The match rate is the percentage of usable calls (two letters of ACGT) whose place became a measured variant.
    ``calls`` has one row (chromosome, position, call_genotype) per place; null without usable calls.
    """
    measured = F.col("user_source") == GENOTYPED
    q = F.col("user_quality")
    usable = calls.filter(F.col("call_genotype").rlike("^[ACGT]{2}$")).groupBy("chromosome").agg(F.count("*").alias("_usable"))
    metrics = merged.groupBy("chromosome").agg(
        F.count("*").alias("variants"), F.count_distinct(F.when(measured, F.col("position"))).alias("_converted"),
        F.avg(q).alias("mean_quality"), F.count_if(q >= 0.9).alias("quality_090"),
        F.count_if((q >= 0.8) & (q < 0.9)).alias("quality_080"),
        F.count_if((q >= 0.3) & (q < 0.8)).alias("quality_030"), F.count_if(q < 0.3).alias("quality_low"),
    )
    rate = F.try_divide(F.col("_converted") * 100.0, F.col("_usable")).alias("match_rate")
    return metrics.join(usable, "chromosome", "left").select(
        "chromosome", "variants", rate, "mean_quality", "quality_090", "quality_080", "quality_030", "quality_low")


# -- panel -----------------------------------------------------------------------------

def panel_mean_dosage(merged: DataFrame, dosage_of) -> DataFrame:
    """Mean panel dosage and its half, the allele frequency, per variant.

    The mean runs over the row's own array, so nothing is exploded or shuffled.
    """
    total = F.aggregate(F.transform("sample_genotypes", dosage_of), F.lit(0.0), lambda a, x: a + x)
    mean = total / F.size("sample_genotypes")
    return merged.select(
        "rsid", "chromosome", "position", "ref_allele", "alt_allele", mean.alias("mean_dosage"),
        (mean / 2.0).alias("panel_frequency"))


# -- merged rows, in their own arrays ---------------------------------------------------
# Each gives what its namesake below gives over the long table, from 51 times fewer rows: a row's samples are folded
# where they stand, and only the results meet other rows of the same site.

_SITE = ["chromosome", "position", "ref_allele", "alt_allele"]


def _panel_dosage() -> Column:
    return F.aggregate(F.transform("sample_genotypes", genotype_text_dosage), F.lit(0.0), lambda a, x: a + x)


def mean_dosage_of_rows(merged: DataFrame) -> DataFrame:
    samples = F.size("sample_genotypes") + F.col("user_dosage").isNotNull().cast("int")
    return merged.groupBy("rsid", *_SITE).agg(
        (F.sum(_panel_dosage() + F.coalesce("user_dosage", F.lit(0.0))) / F.sum(samples)).alias("mean_dosage"))


def panel_frequency_of_rows(merged: DataFrame) -> DataFrame:
    return merged.groupBy(*_SITE).agg(
        (F.sum(_panel_dosage()) / F.sum(F.size("sample_genotypes")) / 2.0).alias("panel_frequency"), F.min("rsid").alias("rsid"),
        F.max("allele_freq").alias("allele_freq"))


def genotype_distribution_of_rows(merged: DataFrame, keys: list[str]) -> DataFrame:
    """A row's few distinct genotypes are counted in it, and only they are laid out."""
    cells = F.col("sample_genotypes")
    counts = F.transform(F.array_distinct(cells), lambda g: F.struct(g.alias("genotype"), F.size(F.filter(cells, lambda x: x == g)).alias("n")))
    rows = merged.select(*keys, F.explode(counts).alias("_c")).select(*keys, "_c.*")
    return rows.groupBy(*keys, "genotype").agg(F.sum("n").alias("samples"))


def pivot_samples_of_rows(merged: DataFrame, sample_ids: list[str]) -> DataFrame:
    """Dosages of listed samples (samp1, ... as in the long table; the number after the panel's is the person)."""
    def dosage(sample: str) -> Column:
        i = int(sample.removeprefix("samp")) - 1
        panel = genotype_text_dosage(F.get("sample_genotypes", F.lit(i)))
        return F.when(F.size("sample_genotypes") == i, F.col("user_dosage")).when(F.size("sample_genotypes") > i, panel)

    return merged.groupBy(*_SITE).agg(*[F.max(dosage(s)).alias(s) for s in sample_ids])


def dataset_profile_of_rows(merged: DataFrame) -> DataFrame:
    """One scan; rows are grouped by site, then chromosome."""
    samples = F.size("sample_genotypes") + 1
    sites = merged.groupBy(*_SITE).agg(
        F.sum(samples).alias("_rows"), F.sum(samples * F.col("is_typed").cast("int")).alias("_typed"), F.max(samples).alias("_samples"))
    totals = sites.groupBy("chromosome").agg(
        F.count("*").alias("_variants"), F.sum("_rows").alias("_rows"), F.sum("_typed").alias("_typed"), F.max("_samples").alias("_samples"))
    return totals.agg(
        F.sum("_variants").alias("variants"), F.count("*").alias("chromosomes"), F.sum("_rows").alias("long_rows"),
        F.sum("_typed").alias("typed_rows"), F.max("_samples").cast("bigint").alias("samples"))


# -- long table ------------------------------------------------------------------------

def mean_dosage(long: DataFrame) -> DataFrame:
    """Mean dosage per variant over all rows of the long table."""
    return long.groupBy("rsid", "chromosome", "position", "ref_allele", "alt_allele").agg(
        F.avg("dosage").alias("mean_dosage"))


def panel_frequency(long: DataFrame, user_sample: str = "samp51") -> DataFrame:
    """Allele frequency by mean panel dosage, with one deterministic value of each attribute."""
    return long.filter(F.col("sample_id") != user_sample).groupBy("chromosome", "position", "ref_allele", "alt_allele").agg(
        (F.avg("dosage") / 2.0).alias("panel_frequency"), F.min("rsid").alias("rsid"),
        F.max("allele_freq").alias("allele_freq"))


def genotype_distribution(long: DataFrame, keys: list[str], user_sample: str = "samp51") -> DataFrame:
    """Panel samples per genotype text."""
    return long.filter(F.col("sample_id") != user_sample).groupBy(*keys, "genotype").agg(F.count("*").alias("samples"))


def pivot_samples(long: DataFrame, sample_ids: list[str], column: str = "dosage") -> DataFrame:
    """One row per variant, one column per listed sample."""
    return long.groupBy("chromosome", "position", "ref_allele", "alt_allele").pivot("sample_id", sample_ids).agg(F.max(column))


def dataset_profile(long: DataFrame) -> DataFrame:
    """Distinct variants, samples and chromosomes; rows and typed rows.

    Variants are told apart by their site key. They are grouped once; the group rows are then
    counted, so no distinct set is held in memory.
    """
    sites = long.groupBy("chromosome", "position", "ref_allele", "alt_allele").agg(
        F.count("*").alias("_rows"), F.sum("is_typed").alias("_typed"))
    totals = sites.groupBy("chromosome").agg(
        F.count("*").alias("_variants"), F.sum("_rows").alias("_rows"), F.sum("_typed").alias("_typed"),
    ).agg(
        F.sum("_variants").alias("variants"), F.count("*").alias("chromosomes"),
        F.sum("_rows").alias("long_rows"), F.sum("_typed").alias("typed_rows"))
    samples = long.groupBy("sample_id").agg(F.count("*").alias("_n")).agg(F.count("*").alias("samples"))
    return totals.withColumn("_k", F.lit(1)).join(F.broadcast(samples.withColumn("_k", F.lit(1))), "_k").drop("_k")


def describe_quality(df: DataFrame, by: list[str] | None = None, column: str = _Q) -> DataFrame:
    """count, mean, sd (n-1), min, exact quartiles, max. The input is read once; groups without a value have no row."""
    keyed = df if by else df.withColumn("_all", F.lit(1))
    keys = by or ["_all"]
    rows = describe_counts(value_counts(keyed, keys, column), keys, column, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return rows.drop(*([] if by else ["_all"]))


def quality_tiers(df: DataFrame, by: list[str] | None = None, column: str = _Q) -> DataFrame:
    """Rows per tier of R2, with the mean and range."""
    q = F.col(column)
    return df.groupBy(*(by or [])).agg(
        F.count("*").alias("rows"), F.count_if(q >= 0.9).alias("r2_090"), F.count_if(q >= 0.8).alias("r2_080"),
        F.count_if(q >= 0.3).alias("r2_030"), F.count_if(q < 0.3).alias("r2_low"),
        F.count_if(q.isNull()).alias("r2_unknown"), F.avg(q).alias("mean_r2"), F.min(q).alias("min_r2"), F.max(q).alias("max_r2"))


def duplicate_ids(df: DataFrame) -> DataFrame:
    """Distinct rsids, rsids on more than one row and the rows beyond the first."""
    per_id = df.filter(F.col("rsid").isNotNull()).groupBy("rsid").agg(F.count("*").alias("n"))
    return per_id.agg(
        F.count("*").alias("distinct_ids"), F.count_if(F.col("n") > 1).alias("repeated_ids"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra_rows"))


# -- array calls -----------------------------------------------------------------------

def _letters(genotype: str, letter: str) -> Column:
    g = F.col(genotype)
    return (F.substring(g, 1, 1) == letter).cast("int") + (F.substring(g, 2, 1) == letter).cast("int")


def call_summary(calls: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Calls, heterozygosity, transition/transversion ratio and letter frequencies.

    Only calls of two ACGT letters count, no-calls and D/I are left out. Transitions are
    heterozygous A/G and C/T calls, transversions the other heterozygous ones.
    """
    het = is_heterozygous("genotype")
    transition = F.col("genotype").isin("AG", "GA", "CT", "TC")
    clean = het.isNotNull()
    counts = {x: F.sum(F.when(clean, _letters("genotype", x)).otherwise(0)) for x in "ACGT"}
    out = calls.groupBy(*(by or [])).agg(
        F.count("*").alias("total"), F.count_if(clean).alias("called"), F.count_if(het).alias("heterozygous"),
        F.count_if(het & transition).alias("transitions"), F.count_if(het & ~transition).alias("transversions"),
        *[c.alias(f"_{x}") for x, c in counts.items()],
    )
    letters = F.col("called") * 2
    return out.select(
        *(by or []), "total", "called", "heterozygous",
        F.try_divide("heterozygous", "called").alias("heterozygosity"), "transitions", "transversions",
        F.try_divide("transitions", "transversions").alias("ts_tv"),
        *[F.try_divide(F.col(f"_{x}"), letters).alias(f"freq_{x.lower()}") for x in "ACGT"],
    )


def chromosome_summary(calls: DataFrame) -> DataFrame:
    """Per chromosome text: calls, heterozygous calls and their rate among clean calls."""
    het = is_heterozygous("genotype")
    return calls.groupBy("chromosome").agg(
        F.count("*").alias("total"), F.count_if(het).alias("heterozygous"),
        F.try_divide(F.count_if(het), F.count_if(het.isNotNull())).alias("heterozygosity"))


def chromosome_order() -> list[Column]:
    """Numbers first by value, then names."""
    return [F.col("chromosome").try_cast("int").asc_nulls_last(), F.col("chromosome").asc()]


def letter_frequencies(calls: DataFrame) -> DataFrame:
    """letter, letters, frequency over clean calls."""
    clean = calls.filter(is_heterozygous("genotype").isNotNull())
    counts = clean.agg(*[F.coalesce(F.sum(_letters("genotype", x)), F.lit(0)).alias(x) for x in "ACGT"])
    rows = counts.unpivot([], list("ACGT"), "letter", "letters")
    total = counts.select((F.col("A") + F.col("C") + F.col("G") + F.col("T")).alias("_total"), F.lit(1).alias("_k"))
    return rows.withColumn("_k", F.lit(1)).join(F.broadcast(total), "_k").select(
        "letter", "letters", F.try_divide("letters", "_total").alias("frequency"))


def snp_rows(df: DataFrame) -> DataFrame:
    return df.filter(is_snp("ref_allele", "alt_allele"))
