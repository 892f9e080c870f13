"""Genotype and dosage expressions. Every function takes and returns Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from locusloom.schemas import GENOTYPED, IMPUTED, IMPUTED_LOW, LOW_QUALITY_R2

ColumnOrName = Column | str


def _c(value: ColumnOrName) -> Column:
    return F.col(value) if isinstance(value, str) else value


def is_snp(ref: ColumnOrName, alt: ColumnOrName) -> Column:
    """Both alleles are a single letter."""
    return (F.length(_c(ref)) == 1) & (F.length(_c(alt)) == 1)


def is_no_call(genotype: ColumnOrName) -> Column:
    g = _c(genotype)
    return g.isNull() | g.isin("--", "")


def call_dosage(genotype: ColumnOrName, ref: ColumnOrName, alt: ColumnOrName) -> Column:
    """ALT letters in a two-letter call, NULL when the call cannot be expressed in REF/ALT."""
    g, r, a = _c(genotype), _c(ref), _c(alt)
    first, second = F.substring(g, 1, 1), F.substring(g, 2, 1)
    usable = (
        ~is_no_call(g) & (F.length(g) == 2) & is_snp(r, a)
        & ((first == a) | (first == r)) & ((second == a) | (second == r))
    )
    return F.when(usable, (first == a).cast("double") + (second == a).cast("double"))


def call_status(genotype: ColumnOrName, ref: ColumnOrName, alt: ColumnOrName) -> Column:
    """``missing``, ``invalid_format``, ``alleles_mismatch`` or ``ok``."""
    g = _c(genotype)
    return (
        F.when(is_no_call(g), F.lit("missing"))
        .when(F.length(g) != 2, F.lit("invalid_format"))
        .when(call_dosage(g, ref, alt).isNull(), F.lit("alleles_mismatch"))
        .otherwise(F.lit("ok"))
    )


def genotype_to_dosage(genotype: ColumnOrName, ref: ColumnOrName, alt: ColumnOrName) -> Column:
    """STRUCT<dosage, status> of one call."""
    return F.struct(
        call_dosage(genotype, ref, alt).alias("dosage"),
        call_status(genotype, ref, alt).alias("status"),
    )


def flip_strand(genotype: ColumnOrName) -> Column:
    """Complement each letter in place; other characters stay."""
    return F.translate(_c(genotype), "ACGT", "TGCA")


def call_dosage_with_flip(genotype: ColumnOrName, ref: ColumnOrName, alt: ColumnOrName) -> Column:
    """Direct conversion, else that of the complemented call.

    For A/T and C/G sites the direct reading always wins, so the strand is never guessed there.
    """
    return F.coalesce(call_dosage(genotype, ref, alt), call_dosage(flip_strand(genotype), ref, alt))


def dosage_genotype(dosage: ColumnOrName, rule: str = "nearest") -> Column:
    """Phased text of a dosage: cuts at 0.5/1.5 (``nearest``) or 0.25/1.25 (``half_step``)."""
    cuts = {"nearest": (0.5, 1.5), "half_step": (0.25, 1.25)}
    if rule not in cuts:
        raise ValueError(f"unknown genotype rule: {rule}")
    low, high = cuts[rule]
    d = _c(dosage)
    return F.when(d < low, F.lit("0|0")).when(d < high, F.lit("0|1")).when(d.isNotNull(), F.lit("1|1"))


# Dosage of the genotype texts that make up nearly all panel cells; the general rule below
# gives the same values, this only saves splitting the text.
COMMON_GENOTYPES = {
    "0|0": 0, "0|1": 1, "1|0": 1, "1|1": 2,
    "0/0": 0, "0/1": 1, "1/0": 1, "1/1": 2,
    "./.": 0, ".|.": 0,
}


def _allele_index(text: Column) -> Column:
    return F.when(text.rlike(r"^\+?[0-9]{1,9}$"), text.cast("int")).otherwise(F.lit(0))


def genotype_text_dosage(genotype: ColumnOrName) -> Column:
    """Sum of the two allele indices of ``a|b`` or ``a/b``; anything else is 0."""
    g = _c(genotype)
    parts = F.split(g, r"[|/]")
    general = F.when(
        F.size(parts) == 2, (_allele_index(parts[0]) + _allele_index(parts[1])).cast("double")
    ).otherwise(F.lit(0.0))
    return _by_common_text(g, lambda n: F.lit(float(n)), general)


def genotype_dosage_text(genotype: ColumnOrName) -> Column:
    """The same dosage printed with three decimals, for VCF cells."""
    g = _c(genotype)
    general = F.concat(genotype_text_dosage(g).cast("bigint").cast("string"), F.lit(".000"))
    return _by_common_text(g, lambda n: F.lit(f"{n}.000"), general)


def _by_common_text(g: Column, value, general: Column) -> Column:
    groups: dict[int, list[str]] = {}
    for text, n in COMMON_GENOTYPES.items():
        groups.setdefault(n, []).append(text)
    branches = [(g.isin(texts), value(n)) for n, texts in sorted(groups.items())]
    first, rest = branches[0], branches[1:]
    chain = reduce(lambda acc, b: acc.when(b[0], b[1]), rest, F.when(first[0], first[1]))
    return chain.otherwise(general)


def has_extra_alleles(genotype: ColumnOrName) -> Column:
    """An allele index above 1, whose dosage is not a count of the first ALT."""
    return _c(genotype).rlike(r"(^|[|/])([2-9]|[1-9][0-9]+)([|/]|$)")


def imputed_source(quality: ColumnOrName) -> Column:
    """Source of an imputed value: low quality below R2 0.3; unknown quality counts as good."""
    return F.when(_c(quality) < LOW_QUALITY_R2, F.lit(IMPUTED_LOW)).otherwise(F.lit(IMPUTED))


def panel_source(is_typed: ColumnOrName) -> Column:
    return F.when(_c(is_typed).cast("boolean"), F.lit(GENOTYPED)).otherwise(F.lit(IMPUTED))


def passes_quality(quality: ColumnOrName, min_r2: float | None) -> Column:
    """No threshold or no quality passes; else quality must be a number that reaches the threshold."""
    if min_r2 is None:
        return F.lit(True)
    q = _c(quality)
    return q.isNull() | ((q >= F.lit(float(min_r2))) & ~F.isnan(q))  # NaN sorts above every number


def is_identifier(rsid: ColumnOrName) -> Column:
    """A variant's name that may be matched: not NULL, empty or the dot that stands for none."""
    r = _c(rsid)
    return r.isNotNull() & ~F.trim(r).isin("", ".")


def is_heterozygous(genotype: ColumnOrName) -> Column:
    """Two different letters of ACGT; NULL when the call has anything else."""
    g = _c(genotype)
    return F.when(g.rlike("^[ACGT]{2}$"), F.substring(g, 1, 1) != F.substring(g, 2, 1))


def display_call(genotype: ColumnOrName, ref: ColumnOrName, alt: ColumnOrName) -> Column:
    """A call as unphased VCF text, ``./.`` when it does not fit REF/ALT."""
    d = call_dosage(genotype, ref, alt)
    return F.when(d == 0, F.lit("0/0")).when(d == 1, F.lit("0/1")).when(d == 2, F.lit("1/1")).otherwise(F.lit("./."))


def autosome_number(chromosome: ColumnOrName) -> Column:
    """Array-call chromosome text to 1..22, NULL for X, Y, MT and anything else."""
    c = _c(chromosome)
    return F.when(c.rlike("^([1-9]|1[0-9]|2[0-2])$"), c.cast("int"))


def vcf_chromosome(chromosome: ColumnOrName) -> Column:
    """VCF contig to 1..22 with any leading ``chr`` removed, else NULL."""
    digits = F.regexp_replace(_c(chromosome), "^(chr)+", "")
    n = F.when(digits.rlike(r"^\+?[0-9]{1,9}$"), digits.cast("int"))
    return F.when(n.between(1, 22), n)
