"""File-name, parameter and record-text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from locusloom.functions.genotype import ColumnOrName, _c

# Audit severities by event type; every other type is ``info``.
SEVERITY_BY_EVENT = {
    "warning": ["auth_failure", "access_denied", "malware_detected"],
    "error": ["job_failed", "invalid_input"],
    "critical": ["unusual_activity", "file_rejected"],
}

# Fixed value: shape of an e-mail address, compared without regard to case.
EMAIL_PATTERN = r"(?i)^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"

OUTPUT_FORMATS = ["parquet", "vcf", "tables", "json"]
DEFAULT_FORMATS = ["parquet", "vcf"]


def safe_file_name(name: ColumnOrName) -> Column:
    """Path separators and NUL become ``_``, other unusual characters go, at most 255 remain."""
    cleaned = F.regexp_replace(_c(name), r"[/\\\x00]", "_")
    return F.substring(F.regexp_replace(cleaned, r"[^A-Za-z0-9_.-]", ""), 1, 255)


def file_extension(name: ColumnOrName, score_files: bool = False) -> Column:
    """Lower-cased extension; ``vcf.gz`` and ``vcf.gz.tbi`` count as one.

    With ``score_files`` also ``.txt.gz`` and ``.pgs`` map to ``pgs``.
    """
    n = _c(name)
    chain = F.when(n.endswith(".vcf.gz"), F.lit("vcf.gz")).when(n.endswith(".vcf.gz.tbi"), F.lit("vcf.gz.tbi"))
    if score_files:
        chain = chain.when(n.endswith(".pgs") | n.endswith(".txt.gz"), F.lit("pgs"))
    return chain.otherwise(F.lower(F.substring_index(n, ".", -1)))


def base_name(path: ColumnOrName) -> Column:
    return F.substring_index(_c(path), "/", -1)


def is_email(text: ColumnOrName) -> Column:
    return _c(text).rlike(EMAIL_PATTERN)


def json_field(document: ColumnOrName, name: str, default: str) -> Column:
    """A text field of a JSON column, ``default`` when it is absent."""
    return F.coalesce(F.get_json_object(_c(document), f"$.{name}"), F.lit(default))


def vcf_layout(document: ColumnOrName) -> Column:
    """``merged`` or ``per_chromosome`` from a job's metadata; anything else is ``merged``."""
    value = F.lower(F.trim(json_field(document, "vcf_format", "merged")))
    return F.when(value == "per_chromosome", value).otherwise(F.lit("merged"))


def audit_severity(event_type: ColumnOrName) -> Column:
    e = _c(event_type)
    chain = F.when(e.isNull(), F.lit("info"))
    for severity, types in SEVERITY_BY_EVENT.items():
        chain = chain.when(e.isin(types), F.lit(severity))
    return chain.otherwise(F.lit("info"))


def is_security_event(event_type: ColumnOrName, severity: ColumnOrName) -> Column:
    """Severity warning or critical, or a type that ends in ``failure`` or ``denied``."""
    e, s = _c(event_type), _c(severity)
    return F.coalesce(s.isin("warning", "critical"), F.lit(False)) | F.coalesce(
        e.like("%failure") | e.like("%denied"), F.lit(False)
    )


def sample_map_to_array(json_text: ColumnOrName, samples: int = 50) -> Column:
    """``{"samp1": "0|0", ...}`` to an array ordered samp1, samp2, ...; NULL where a key is absent."""
    names = [f"samp{i}" for i in range(1, samples + 1)]
    parsed = F.from_json(_c(json_text), ", ".join(f"{n} string" for n in names))
    # The lambda's variable holds the parsed object, so each text is parsed once for all samples.
    return F.transform(F.array(parsed), lambda doc: F.array(*[doc[n] for n in names]))[0]


def array_to_sample_map(genotypes: ColumnOrName) -> Column:
    """The reverse: an ordered array as a JSON object."""
    g = _c(genotypes)
    keys = F.transform(F.sequence(F.lit(1), F.size(g)), lambda i: F.concat(F.lit("samp"), i.cast("string")))
    return F.to_json(F.map_from_arrays(keys, g))


def parse_threshold(text: str | None) -> float | None:
    """``none`` -> None, ``r080``/``0.8`` -> 0.8, everything else -> 0.9."""
    value = (text or "").strip().lower()
    if value == "none":
        return None
    return 0.8 if value in ("r080", "0.8") else 0.9


def parse_threshold_column(text: ColumnOrName) -> Column:
    value = F.lower(F.trim(_c(text)))
    return F.when(value == "none", F.lit(None).cast("double")).when(
        value.isin("r080", "0.8"), F.lit(0.8)
    ).otherwise(F.lit(0.9))


def parse_formats(names: list[str] | None) -> list[str]:
    """Distinct known output formats in a fixed order; none named means Parquet and VCF."""
    wanted = {n.strip().lower() for n in names or []}
    unknown = wanted - set(OUTPUT_FORMATS)
    if unknown:
        raise ValueError(f"unknown output formats: {sorted(unknown)}")
    return [n for n in OUTPUT_FORMATS if n in wanted] or list(DEFAULT_FORMATS)


def parse_formats_column(text: ColumnOrName) -> Column:
    """A comma-separated list to a sorted array of distinct formats, default Parquet and VCF."""
    items = F.array_sort(F.array_distinct(F.filter(
        F.transform(F.split(_c(text), ","), lambda x: F.lower(F.trim(x))),
        lambda x: x.isin(OUTPUT_FORMATS),
    )))
    default = F.array(*[F.lit(n) for n in DEFAULT_FORMATS])
    return F.when(F.size(F.coalesce(items, F.array().cast("array<string>"))) > 0, items).otherwise(default)
