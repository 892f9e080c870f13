"""Merging a reference panel with one person's measured calls and imputed dosages.

The merged frame is *compact*: one row per panel variant with the panel's genotype array as
stored and the person's value in ``user_*`` columns. It is widened to an array of 51 structs
or exploded to 51 rows only where a sink or an aggregate needs that.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusloom.functions.genotype import (
    autosome_number,
    call_dosage,
    call_dosage_with_flip,
    dosage_genotype,
    genotype_text_dosage,
    imputed_source,
    is_identifier,
    panel_source,
    passes_quality,
)
from locusloom.operators.dedup import last_wins
from locusloom.schemas import (
    GENOTYPED,
    IMPUTED,
    IMPUTED_LOW,
    LONG_COLUMNS,
    PANEL_SAMPLES,
    SINGLE_COLUMNS,
    SITE_KEY,
    USER_SAMPLE,
)
from locusloom.sources.lines import LINE_ORDER


@dataclass(frozen=True)
class MergeRules:
    """How the person's value at a panel variant is chosen.

    call_match: ``position`` joins calls by place, ``letters`` by place and the call's two
        letters as REF and ALT.
    require_imputed: a measured call counts only where an imputed row exists as well.
    missing: ``reference`` fills 0|0 with the panel's R2, ``nocall`` fills ./. as low quality.
    genotype_rule: cuts of ``dosage_genotype``.
    raw_call: show the call's own letters and keep the imputed R2 beside a measured call.
    key: ``site`` joins on place and alleles, ``rsid`` on the identifier.
    unique_inputs: calls and imputed rows are known to have one row per key.
    """

    call_match: str = "position"
    require_imputed: bool = False
    missing: str = "reference"
    genotype_rule: str = "nearest"
    raw_call: bool = False
    strand_flip: bool = False
    panel_min_r2: float | None = 0.9
    rsid_prefix: str = ""
    key: str = "site"
    unique_inputs: bool = False

    def __post_init__(self) -> None:
        for name, allowed in (
            ("call_match", ("position", "letters")), ("missing", ("reference", "nocall")),
            ("key", ("site", "rsid")),
        ):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {allowed}")
        if self.key == "rsid" and self.call_match == "letters":
            raise ValueError("calls matched by letters need key='site'")

    def with_(self, **changes) -> MergeRules:
        return replace(self, **changes)


DEFAULT_RULES = MergeRules()
WORKER_RULES = MergeRules(call_match="letters", genotype_rule="half_step")
LIBRARY_RULES = MergeRules(require_imputed=True, missing="nocall", raw_call=True, rsid_prefix="chr")


def _order(df: DataFrame, order: list[str] | None) -> list[str]:
    return order if order is not None else [c for c in LINE_ORDER if c in df.columns]


def autosomal(calls: DataFrame) -> DataFrame:
    """Calls of chromosomes 1..22 with the chromosome as INT."""
    if dict(calls.dtypes)["chromosome"] != "string":
        return calls
    return calls.withColumn("chromosome", autosome_number("chromosome")).filter(F.col("chromosome").isNotNull())


def unique_calls(calls: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Autosomal calls, last one per key, as keys and ``call_genotype``."""
    order = _order(calls, order)
    c = autosomal(calls).select(*keys, F.col("genotype").alias("call_genotype"), *order)
    return last_wins(c, keys, order, ["call_genotype"], for_join=True)


def unique_imputed(imputed: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Imputed rows, last one per key, as keys, ``imputed_dosage`` and ``imputed_r2``."""
    order = _order(imputed, order)
    i = imputed.select(
        *keys, F.col("dosage").alias("imputed_dosage"), F.col("imputation_quality").alias("imputed_r2"), *order,
    )
    return last_wins(i, keys, order, ["imputed_dosage", "imputed_r2"], for_join=True)


def unique_calls_by_letters(calls: DataFrame, order: list[str] | None = None, place: list[str] | None = None) -> DataFrame:
    """Autosomal calls with their two letters as REF and ALT, last one per site, as keys and ``call_genotype``."""
    order, place = _order(calls, order), place or ["chromosome", "position"]

    def letter(i: int) -> Column:
        # Never NULL, which spares a join the check.
        return F.coalesce(F.when(F.length("genotype") >= i, F.substring("genotype", i, 1)), F.lit("-"))

    c = autosomal(calls).select(
        *place, letter(1).alias("ref_allele"), letter(2).alias("alt_allele"), F.col("genotype").alias("call_genotype"), *order)
    return last_wins(c, [*place, "ref_allele", "alt_allele"], order, ["call_genotype"], for_join=True)


def join_user_data(
    panel: DataFrame, calls: DataFrame, imputed: DataFrame, rules: MergeRules = DEFAULT_RULES,
    call_order: list[str] | None = None, imputed_order: list[str] | None = None,
) -> DataFrame:
    """Panel rows with ``call_genotype``, ``imputed_dosage`` and ``imputed_r2`` where found.

    No join is hinted: Spark broadcasts the person's side when its size is below the
    threshold and shuffles both sides otherwise. Calls come first, so that the wide panel rows
    are partitioned once, by place, for both joins.
    """
    sites = panel.filter(passes_quality("imputation_quality", rules.panel_min_r2))
    if rules.key == "rsid":
        # Rows without an identifier get a key of their own: they match nothing and do not
        # all land in one partition, as NULL keys would.
        sites = sites.withColumn("_id", F.coalesce(
            F.when(is_identifier("rsid"), F.col("rsid")),
            F.concat_ws(":", F.lit("\u0001"), "chromosome", "position", "ref_allele", "alt_allele")))
        c = unique_calls(calls.filter(is_identifier("rsid")), ["rsid"], call_order)
        i = unique_imputed(imputed.filter(is_identifier("rsid")), ["rsid"], imputed_order)
        return (
            sites.join(c.withColumnRenamed("rsid", "_id"), "_id", "left")
            .join(i.withColumnRenamed("rsid", "_id"), "_id", "left").drop("_id")
        )
    if rules.call_match == "letters":
        c = unique_calls_by_letters(calls, call_order)
        return sites.join(c, SITE_KEY, "left").join(unique_imputed(imputed, SITE_KEY, imputed_order), SITE_KEY, "left")
    if rules.unique_inputs:
        c = autosomal(calls).select("chromosome", "position", F.col("genotype").alias("call_genotype"))
        i = imputed.select(
            *SITE_KEY, F.col("dosage").alias("imputed_dosage"), F.col("imputation_quality").alias("imputed_r2"))
    else:
        c = unique_calls(calls, ["chromosome", "position"], call_order)
        i = unique_imputed(imputed, SITE_KEY, imputed_order)
    return sites.join(c, ["chromosome", "position"], "left").join(i, SITE_KEY, "left")


def resolve_user(joined: DataFrame, rules: MergeRules = DEFAULT_RULES) -> DataFrame:
    """Turn the joined columns into the person's genotype, dosage, source and quality."""
    convert = call_dosage_with_flip if rules.strand_flip else call_dosage
    measured_dosage = convert("call_genotype", "ref_allele", "alt_allele")
    has_imputed = F.col("imputed_dosage").isNotNull()
    rows = joined.withColumn("_measured", measured_dosage)
    measured = F.col("_measured").isNotNull()
    if rules.require_imputed:
        measured = measured & has_imputed
    panel_r2 = F.col("imputation_quality")
    nothing = F.lit(None).cast("double")
    empty_text, empty_source, empty_quality = (
        ("0|0", IMPUTED, panel_r2) if rules.missing == "reference" else ("./.", IMPUTED_LOW, nothing)
    )
    measured_text = F.col("call_genotype") if rules.raw_call else dosage_genotype("_measured", rules.genotype_rule)
    measured_quality = F.col("imputed_r2") if rules.raw_call else nothing

    def pick(when_measured: Column, when_imputed: Column, otherwise: Column) -> Column:
        return F.when(measured, when_measured).when(has_imputed, when_imputed).otherwise(otherwise)

    site_name = F.concat(F.lit(rules.rsid_prefix), F.col("chromosome").cast("string"), F.lit(":"), F.col("position").cast("string"))
    return rows.select(
        F.coalesce("rsid", site_name).alias("rsid"), "chromosome", "position", "ref_allele", "alt_allele",
        "allele_freq", "minor_allele_freq", "is_typed", panel_r2.alias("panel_quality"), "sample_genotypes",
        pick(measured_text, dosage_genotype("imputed_dosage", rules.genotype_rule), F.lit(empty_text)).alias("user_genotype"),
        pick(F.col("_measured"), F.col("imputed_dosage"), F.lit(0.0)).alias("user_dosage"),
        pick(F.lit(GENOTYPED), imputed_source("imputed_r2"), F.lit(empty_source)).alias("user_source"),
        pick(measured_quality, F.col("imputed_r2"), empty_quality).alias("user_quality"),
        (measured | has_imputed).alias("user_observed"),
    )


def merge_multi_sample(
    panel: DataFrame, calls: DataFrame, imputed: DataFrame, rules: MergeRules = DEFAULT_RULES,
    call_order: list[str] | None = None, imputed_order: list[str] | None = None,
) -> DataFrame:
    """Compact merged frame: one row per panel variant that passes the panel quality filter."""
    return resolve_user(join_user_data(panel, calls, imputed, rules, call_order, imputed_order), rules)


def single_sample_candidates(
    imputed: DataFrame, calls: DataFrame, user_min_r2: float | None = 0.9, call_order: list[str] | None = None,
) -> DataFrame:
    """Imputed rows with the measured call preferred, and ``kept`` after the quality filter.

    Measured values are kept whatever the imputed quality is.
    """
    c = unique_calls(calls, ["chromosome", "position"], call_order)
    rows = imputed.join(c, ["chromosome", "position"], "left").withColumn(
        "_measured", call_dosage("call_genotype", "ref_allele", "alt_allele"))
    measured = F.col("_measured").isNotNull()
    r2 = F.col("imputation_quality")
    return rows.select(
        "rsid", "chromosome", "position", "ref_allele", "alt_allele",
        F.coalesce("_measured", "dosage").alias("dosage"),
        F.when(measured, F.lit(GENOTYPED)).otherwise(imputed_source(r2)).alias("source"),
        F.when(~measured, r2).alias("imputation_quality"),
        (measured | passes_quality(r2, user_min_r2)).alias("kept"),
    )


def merge_single_sample(
    imputed: DataFrame, calls: DataFrame, user_min_r2: float | None = 0.9, call_order: list[str] | None = None,
) -> DataFrame:
    """One row per imputed row that is measured or passes the quality filter."""
    rows = single_sample_candidates(imputed, calls, user_min_r2, call_order)
    return rows.filter("kept").select(*SINGLE_COLUMNS)


def single_sample_counters(candidates: DataFrame) -> DataFrame:
    """Per chromosome: genotyped, imputed, filtered and total of the single-sample merge."""
    kept, typed = F.col("kept"), F.col("source") == GENOTYPED
    return candidates.groupBy("chromosome").agg(
        F.count_if(kept & typed).alias("genotyped"), F.count_if(kept & ~typed).alias("imputed"),
        F.count_if(~kept).alias("filtered"), F.count_if(kept).alias("total"),
    )


def merge_counters(panel: DataFrame, merged: DataFrame, rules: MergeRules = DEFAULT_RULES) -> DataFrame:
    """Per chromosome: the person's genotyped, imputed and absent variants, filtered and total."""
    observed, typed = F.col("user_observed"), F.col("user_source") == GENOTYPED
    counts = merged.groupBy("chromosome").agg(
        F.count_if(typed).alias("genotyped"), F.count_if(observed & ~typed).alias("imputed"),
        F.count_if(~observed).alias("absent"), F.count("*").alias("total"),
    )
    dropped = panel.groupBy("chromosome").agg(
        F.count_if(~passes_quality("imputation_quality", rules.panel_min_r2)).alias("filtered"))
    zero = F.lit(0)
    return dropped.join(counts, "chromosome", "left").select(
        "chromosome", *[F.coalesce(c, zero).alias(c) for c in ("genotyped", "imputed", "absent")],
        "filtered", F.coalesce("total", zero).alias("total"),
    )


def user_sample() -> Column:
    """The person's struct in ``samples``."""
    return F.struct(
        F.lit(USER_SAMPLE).alias("sample_id"), F.col("user_genotype").alias("genotype"),
        F.col("user_dosage").alias("dosage"), F.col("user_source").alias("source"),
        F.col("user_quality").alias("imputation_quality"),
    )


#: The columns of a variant itself in the wide form.
SITE_COLUMNS = ["rsid", *SITE_KEY, "allele_freq", "minor_allele_freq", "is_typed"]


def samples() -> Column:
    """Array of 51 structs, samp1..samp50 in panel order and the person last."""
    source = panel_source("is_typed")

    def panel_sample(genotype: Column, i: Column) -> Column:
        return F.struct(
            F.concat(F.lit("samp"), (i + 1).cast("string")).alias("sample_id"), genotype.alias("genotype"),
            genotype_text_dosage(genotype).alias("dosage"), source.alias("source"),
            F.col("panel_quality").alias("imputation_quality"),
        )

    return F.concat(F.transform("sample_genotypes", panel_sample), F.array(user_sample()))


def with_samples(merged: DataFrame) -> DataFrame:
    """Wide form: the variant's columns and its ``samples``."""
    return merged.select(*SITE_COLUMNS, samples().alias("samples"))


def _sample_name(number: Column) -> Column:
    """samp1, samp2, ... of a 0-based number, from a constant array for the usual 51."""
    names = F.array(*[F.lit(f"samp{i}") for i in range(1, PANEL_SAMPLES + 2)])
    return F.coalesce(F.get(names, number), F.concat(F.lit("samp"), (number + 1).cast("string")))


def to_long(merged: DataFrame) -> DataFrame:
    """One row per variant and sample, 13 columns.

    Only genotype texts are exploded; the other sample columns follow from the sample's
    number in generated code.
    """
    # The array's size is taken before the explode, so the array itself is not copied into
    # each of the 51 rows. The outer form spares a filter that would build the array twice.
    rows = merged.withColumns({
        "_last": F.size("sample_genotypes"),
        "_cells": F.concat("sample_genotypes", F.array("user_genotype")),
    }).drop("sample_genotypes", "user_genotype")
    rows = rows.select("*", F.posexplode_outer("_cells").alias("_i", "genotype"))
    user = F.col("_i") == F.col("_last")
    rows = rows.select(
        "rsid", "chromosome", "position", "ref_allele", "alt_allele", "allele_freq", "minor_allele_freq",
        F.col("is_typed").cast("int").alias("is_typed"),
        _sample_name(F.col("_i")).alias("sample_id"), "genotype",
        F.when(user, F.col("user_dosage")).otherwise(genotype_text_dosage("genotype")).alias("dosage"),
        F.when(user, F.col("user_source")).otherwise(panel_source("is_typed")).alias("source"),
        F.when(user, F.col("user_quality")).otherwise(F.col("panel_quality")).alias("imputation_quality"),
    )
    return rows.select(*LONG_COLUMNS)
