"""Comparing two runs, and data-quality rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusloom.functions.genotype import call_dosage, call_dosage_with_flip, genotype_text_dosage, is_identifier, vcf_chromosome
from locusloom.functions.numeric import is_finite, parse_double
from locusloom.operators.dedup import apart
from locusloom.schemas import SITE_KEY
from locusloom.sources.vcf import info_quality


def compare_counts(run_a: DataFrame, run_b: DataFrame, by: str = "chromosome") -> DataFrame:
    """Rows per chromosome in both runs, their difference and ratio."""
    a = run_a.groupBy(by).agg(F.count("*").alias("_a"))
    b = run_b.groupBy(by).agg(F.count("*").alias("_b"))
    both = a.join(b, by, "full_outer").select(
        by, F.coalesce("_a", F.lit(0)).alias("rows_a"), F.coalesce("_b", F.lit(0)).alias("rows_b"))
    return both.withColumns({
        "difference": F.col("rows_b") - F.col("rows_a"), "ratio": F.try_divide("rows_b", "rows_a")})


def _seen(run_a: DataFrame, run_b: DataFrame, keys: list[str]) -> DataFrame:
    """Each key once, with flags ``_a`` and ``_b`` for the runs it is in.

    Both runs are tagged and grouped once, which combines copies of a key before the shuffle.
    """
    tagged = run_a.select(*keys, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(
        run_b.select(*keys, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    return tagged.groupBy(*keys).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))


def key_overlap(run_a: DataFrame, run_b: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Distinct keys only in A, only in B and in both."""
    a, b = F.col("_a") == 1, F.col("_b") == 1
    return _seen(run_a, run_b, keys or SITE_KEY).agg(
        F.count_if(a & ~b).alias("only_a"), F.count_if(b & ~a).alias("only_b"), F.count_if(a & b).alias("both"))


def only_in_first(run_a: DataFrame, run_b: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows of A whose key B lacks."""
    keys = keys or SITE_KEY
    rows, by = apart(run_b, keys)
    return run_a.join(rows.select(*by).distinct().select(*keys), keys, "left_anti")


def in_both(run_a: DataFrame, run_b: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Distinct keys of both runs."""
    keys = keys or SITE_KEY
    return _seen(run_a, run_b, keys).filter((F.col("_a") == 1) & (F.col("_b") == 1)).select(*keys)


def dosage_agreement(run_a: DataFrame, run_b: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """Shared variants, those within the tolerance and the largest difference."""
    a = run_a.select(*SITE_KEY, F.col("user_dosage").alias("_a"))
    b = run_b.select(*SITE_KEY, F.col("user_dosage").alias("_b"))
    gap = F.abs(F.col("_a") - F.col("_b"))
    return a.join(b, SITE_KEY).agg(
        F.count("*").alias("shared"), F.count_if(gap <= tolerance).alias("within_tolerance"), F.max(gap).alias("largest_difference"))


def _rules(df: DataFrame, violations: dict[str, Column]) -> DataFrame:
    """rule, violations: all rules of one frame in one pass."""
    counts = df.agg(*[F.coalesce(c, F.lit(0)).cast("bigint").alias(n) for n, c in violations.items()])
    return counts.unpivot([], list(violations), "rule", "violations")


def quality_report(
    panel: DataFrame, imputed: DataFrame, calls: DataFrame, weights: DataFrame, merged: DataFrame,
    min_coverage: float = 0.5,
) -> DataFrame:
    """One row per rule with the number of violations; 0 means the rule holds."""
    acgt = "^[ACGT]+$"
    repeated = F.sum(F.col("_n") - 1)

    def repeats(df: DataFrame, keys: list[str]) -> DataFrame:
        return df.groupBy(*keys).agg(F.count("*").alias("_n"))

    matched = weights.join(merged.select("chromosome", "position").distinct(), ["chromosome", "position"], "left_semi")
    coverage = repeats(weights, ["trait"]).withColumnRenamed("_n", "_all").join(
        repeats(matched, ["trait"]), "trait", "left")
    numbers = panel.filter(F.col("chromosome").between(1, 22)).select("chromosome").distinct()
    rules = [
        _rules(numbers, {"chromosomes_missing": F.lit(22) - F.count("*")}),
        _rules(repeats(panel.filter(F.col("rsid").isNotNull()), ["rsid"]), {"panel_duplicate_ids": repeated}),
        _rules(imputed, {
            "dosage_out_of_range": F.count_if(~F.col("dosage").between(0.0, 2.0)),
            "alleles_not_acgt": F.count_if(~(F.col("ref_allele").rlike(acgt) & F.col("alt_allele").rlike(acgt)))}),
        _rules(calls, {"call_shape": F.count_if(~F.col("genotype").rlike("^([ACGT]{2}|--|[DI]{2})$"))}),
        _rules(repeats(weights, ["trait", "chromosome", "position"]), {"weight_duplicate_sites": repeated}),
        _rules(coverage, {"traits_below_coverage": F.count_if(F.coalesce("_n", F.lit(0)) < F.col("_all") * min_coverage)}),
    ]
    return reduce(DataFrame.unionAll, rules)


def vcf_version_violations(lines: DataFrame) -> DataFrame:
    """Files with no ``##fileformat=VCFv4.`` line."""
    ok = F.max(F.col("value").startswith("##fileformat=VCFv4.").cast("int"))
    return lines.groupBy("file_path").agg(ok.alias("_ok")).filter(F.col("_ok") == 0).select("file_path")


#: Chromosomes that array calls may name, and comment lines at the head of a calls file.
CALL_CHROMOSOMES = [*map(str, range(1, 23)), "X", "Y", "MT"]
CALL_HEADER_LINES = 12


def _split_once(lines: DataFrame, fields: Column) -> DataFrame:
    """Lines with their fields as ``_f``; exploded, so that no rule splits the line again."""
    return lines.select("value", "file_path", F.explode(F.array(fields)).alias("_f"))


def vcf_line_rules(lines: DataFrame, tags: tuple[str, ...] = ("DR2",), least_version: int = 2) -> DataFrame:
    """Rules of VCF text (value, file_path), from one scan: files that state no version 4.2 or later, data lines off the
    chromosomes 1 to 22, without a number under a required INFO tag, and with other letters than bases in REF or the first ALT."""
    f = F.col("_f")
    data = ~F.col("value").startswith("#") & (F.trim("value") != "")
    version = F.regexp_extract("value", r"^##fileformat=VCFv4[.]([0-9]{1,4})$", 1).try_cast("int")
    bad = {
        "vcf_chromosome": vcf_chromosome(F.get(f, F.lit(0))).isNull(),
        "vcf_info": info_quality(F.coalesce(F.get(f, F.lit(7)), F.lit("")), tags).isNull(),
        "vcf_alleles": ~F.coalesce(F.get(f, F.lit(3)).rlike("^[ACGT]+$") & F.substring_index(F.get(f, F.lit(4)), ",", 1).rlike("^[ACGT]+$"), F.lit(False)),
    }
    per_file = _split_once(lines, F.split("value", "\t")).groupBy("file_path").agg(
        F.max((version >= least_version).cast("int")).alias("_ok"), *[F.count_if(data & c).alias(n) for n, c in bad.items()])
    return _rules(per_file, {"vcf_version": F.count_if(F.coalesce("_ok", F.lit(0)) == 0), **{n: F.sum(n) for n in bad}})


def call_line_rules(lines: DataFrame, header_lines: int = CALL_HEADER_LINES) -> DataFrame:
    """Rules of array-call text (value, file_path), from one scan: files with fewer comment lines, chromosomes of another
    name, and genotypes that are neither two letters nor a no-call."""
    f = F.col("_f")
    comment = F.col("value").startswith("#")
    data = ~comment & (F.trim("value") != "")
    chromosome, genotype = F.get(f, F.lit(1)), F.get(f, F.lit(3))
    per_file = _split_once(lines, F.split(F.trim("value"), r"\s+")).groupBy("file_path").agg(
        F.count_if(comment).alias("_head"),
        F.count_if(data & ~F.coalesce(chromosome.isin(CALL_CHROMOSOMES), F.lit(False))).alias("call_chromosome"),
        F.count_if(data & ~F.coalesce(genotype.rlike("^([ACGT]{2}|--|[DI]{2})$"), F.lit(False))).alias("call_genotype"))
    return _rules(per_file, {
        "call_header": F.count_if(F.col("_head") < header_lines), "call_chromosome": F.sum("call_chromosome"), "call_genotype": F.sum("call_genotype")})


def panel_dosage_rule(panel: DataFrame) -> DataFrame:
    """Panel cells whose dosage is outside 0 to 2, counted in the row's own array."""
    # Dosages first: both bounds would else take each cell's text apart.
    dosages = F.transform("sample_genotypes", lambda g: genotype_text_dosage(g))
    bad = F.size(F.filter(dosages, lambda d: ~d.between(0.0, 2.0)))
    return _rules(panel, {"panel_dosage": F.sum(bad)})


def strand_rule(panel: DataFrame, calls: DataFrame) -> DataFrame:
    """Calls (one row per place, as ``unique_calls`` gives) that fit a panel variant of their place on the other strand only."""
    both = panel.select(*SITE_KEY).join(calls, ["chromosome", "position"])
    fits = call_dosage("call_genotype", "ref_allele", "alt_allele").isNotNull()
    flipped = call_dosage_with_flip("call_genotype", "ref_allele", "alt_allele").isNotNull()
    places = both.groupBy("chromosome", "position").agg(F.max(fits).alias("_fits"), F.max(flipped).alias("_flipped"))
    return _rules(places, {"call_strand": F.count_if(~F.col("_fits") & F.col("_flipped"))})


#: Columns that a weights text must have.
WEIGHT_COLUMNS = ["SNP", "CHR", "BP", "A1", "A2", "weight"]


def weight_rules(weights: DataFrame) -> DataFrame:
    """Rules of a weights table read as text: required columns that are missing, repeated identifiers, weights that are no finite number."""
    missing = [c for c in WEIGHT_COLUMNS if c not in weights.columns]
    rows = weights.select(*[(F.lit(None) if c in missing else F.col(c)).cast("string").alias(c) for c in ("SNP", "weight")])
    value = parse_double("weight")
    per_id = rows.groupBy("SNP").agg(F.count("*").alias("_n"), F.count_if(~F.coalesce(is_finite(value), F.lit(False))).alias("_bad"))
    return _rules(per_id, {
        "weight_columns": F.lit(len(missing)), "weight_duplicate_ids": F.sum(F.when(is_identifier("SNP"), F.col("_n") - 1).otherwise(0)),
        "weight_number": F.sum("_bad")})


def input_rules(
    vcf_lines: DataFrame, call_lines: DataFrame, weights: DataFrame, panel: DataFrame, calls: DataFrame,
    tags: tuple[str, ...] = ("DR2",), header_lines: int = CALL_HEADER_LINES,
) -> DataFrame:
    """rule, violations of the inputs as they arrive, beside those that ``quality_report`` finds in the parsed frames."""
    parts = [vcf_line_rules(vcf_lines, tags), call_line_rules(call_lines, header_lines), weight_rules(weights),
             panel_dosage_rule(panel), strand_rule(panel, calls)]
    return reduce(DataFrame.unionAll, parts)
