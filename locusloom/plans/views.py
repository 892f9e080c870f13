"""The derived frames of ``derived`` once more as SQL text, for checking in another engine.

These are written from the definitions, with other means than the operators use: ranking
windows for the last row of a key, joins with sample numbers instead of arrays.
"""

from __future__ import annotations

import re


def site(k: str) -> str:
    return (
        f"CAST({k} % 22 AS INTEGER) + 1 AS chromosome, 10000 + {k} * 37 AS position, "
        f"substr('ACGT', CAST({k} % 4 AS INTEGER) + 1, 1) AS ref_allele, "
        f"substr('ACGT', CAST(({k} + 1 + {k} % 3) % 4 AS INTEGER) + 1, 1) AS alt_allele"
    )


def call_dosage(g: str, ref: str = "ref_allele", alt: str = "alt_allele") -> str:
    a, b = f"substr({g}, 1, 1)", f"substr({g}, 2, 1)"
    return (
        f"CASE WHEN length({g}) = 2 AND {g} <> '--' AND length({ref}) = 1 AND length({alt}) = 1 "
        f"AND {a} IN ({ref}, {alt}) AND {b} IN ({ref}, {alt}) "
        f"THEN CAST(CASE WHEN {a} = {alt} THEN 1 ELSE 0 END + CASE WHEN {b} = {alt} THEN 1 ELSE 0 END AS DOUBLE) END"
    )


def dosage_genotype(d: str, low: float = 0.5, high: float = 1.5) -> str:
    return f"CASE WHEN {d} IS NULL THEN NULL WHEN {d} < {low} THEN '0|0' WHEN {d} < {high} THEN '0|1' ELSE '1|1' END"


def text_dosage(g: str) -> str:
    return (
        f"CAST(coalesce(TRY_CAST(split_part({g}, '|', 1) AS INTEGER), 0) "
        f"+ coalesce(TRY_CAST(split_part({g}, '|', 2) AS INTEGER), 0) AS DOUBLE)"
    )


_LINE_ORDER = "l_shipdate DESC, l_partkey DESC, l_suppkey DESC"


def _merged(joins: str, measured: str, text: str, quality: str, low: float, high: float, missing: str, source: str, empty_q: str, prefix: str) -> str:
    return f"""
    WITH joined AS (
      SELECT p.*, c.genotype AS call_genotype, i.dosage AS imputed_dosage, i.imputation_quality AS imputed_r2,
             {call_dosage('c.genotype', 'p.ref_allele', 'p.alt_allele')} AS conv
      FROM g_panel p {joins}
      WHERE p.imputation_quality IS NULL OR p.imputation_quality >= 0.9
    ), picked AS (SELECT *, {measured} AS measured, imputed_dosage IS NOT NULL AS has_imputed FROM joined)
    SELECT coalesce(rsid, '{prefix}' || chromosome || ':' || position) AS rsid, chromosome, position, ref_allele, alt_allele,
      allele_freq, minor_allele_freq, is_typed, imputation_quality AS panel_quality, k,
      CASE WHEN measured THEN {text} WHEN has_imputed THEN {dosage_genotype('imputed_dosage', low, high)} ELSE '{missing}' END AS user_genotype,
      CASE WHEN measured THEN conv WHEN has_imputed THEN imputed_dosage ELSE 0.0 END AS user_dosage,
      CASE WHEN measured THEN 'Genotyped' WHEN has_imputed AND imputed_r2 < 0.3 THEN 'ImputedLowQual'
           WHEN has_imputed THEN 'Imputed' ELSE '{source}' END AS user_source,
      CASE WHEN measured THEN {quality} WHEN has_imputed THEN imputed_r2 ELSE {empty_q} END AS user_quality,
      measured OR has_imputed AS user_observed
    FROM picked"""


_BY_PLACE = (
    "LEFT JOIN g_calls_last c ON c.chromosome = p.chromosome AND c.position = p.position "
    "LEFT JOIN g_imputed_last i ON i.chromosome = p.chromosome AND i.position = p.position "
    "AND i.ref_allele = p.ref_allele AND i.alt_allele = p.alt_allele"
)
_BY_LETTERS = (
    "LEFT JOIN g_calls_letters c ON c.chromosome = p.chromosome AND c.position = p.position "
    "AND c.letter1 = p.ref_allele AND c.letter2 = p.alt_allele "
    "LEFT JOIN g_imputed_last i ON i.chromosome = p.chromosome AND i.position = p.position "
    "AND i.ref_allele = p.ref_allele AND i.alt_allele = p.alt_allele"
)
_BY_RSID = "LEFT JOIN g_calls_rsid c ON c.rsid = p.rsid LEFT JOIN g_imputed_rsid i ON i.rsid = p.rsid"


def _default(joins: str) -> str:
    return _merged(joins, "conv IS NOT NULL", dosage_genotype("conv"), "NULL", 0.5, 1.5, "0|0", "Imputed", "imputation_quality", "")


def _long(merged: str) -> str:
    return f"""
    SELECT m.rsid, m.chromosome, m.position, m.ref_allele, m.alt_allele, m.allele_freq, m.minor_allele_freq,
      CAST(m.is_typed AS INTEGER) AS is_typed, 'samp' || s.i AS sample_id, s.genotype,
      {text_dosage('s.genotype')} AS dosage, CASE WHEN m.is_typed THEN 'Genotyped' ELSE 'Imputed' END AS source,
      m.panel_quality AS imputation_quality
    FROM {merged} m JOIN g_panel_samples s ON s.k = m.k
    UNION ALL
    SELECT rsid, chromosome, position, ref_allele, alt_allele, allele_freq, minor_allele_freq, CAST(is_typed AS INTEGER),
      'samp51', user_genotype, user_dosage, user_source, user_quality FROM {merged}"""


def _last(view: str, keys: str, tie: str, where: str = "TRUE") -> str:
    return (
        f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {_LINE_ORDER}, {tie}) AS rn "
        f"FROM {view} WHERE {where}) WHERE rn = 1"
    )


VIEWS: dict[str, str] = {
    "g_sites": f"SELECT o_orderkey AS k, {site('o_orderkey')} FROM orders",
    "g_panel": """
    SELECT k, chromosome, position, CASE WHEN k % 13 <> 0 THEN 'rs' || k END AS rsid, ref_allele, alt_allele,
      CAST(k * 17 % 101 AS DOUBLE) / 100 AS allele_freq,
      least(CAST(k * 17 % 101 AS DOUBLE) / 100, 1 - CAST(k * 17 % 101 AS DOUBLE) / 100) AS minor_allele_freq,
      CASE WHEN k % 11 <> 0 THEN CAST(700 + k * 7919 % 300 AS DOUBLE) / 1000 END AS imputation_quality,
      k % 11 = 0 AS is_typed FROM g_sites""",
    "g_panel_samples": """
    SELECT k, i, ((k * 3 + i) % 2) || '|' || ((k + i * 7) % 2) AS genotype
    FROM g_sites, (SELECT range AS i FROM range(1, 51))""",
    "g_calls": f"""
    SELECT 'rs' || k AS rsid, CASE WHEN k % 19 = 0 THEN 'X' ELSE CAST(chromosome AS VARCHAR) END AS chromosome_text,
      CASE WHEN k % 19 = 0 THEN NULL ELSE chromosome END AS chromosome,
      position + CASE WHEN k % 17 = 0 THEN 1 ELSE 0 END AS position,
      CASE (k + l_suppkey) % 6 WHEN 0 THEN ref_allele || ref_allele WHEN 1 THEN ref_allele || alt_allele
        WHEN 2 THEN alt_allele || ref_allele WHEN 3 THEN alt_allele || alt_allele WHEN 4 THEN '--' ELSE 'DI' END AS genotype,
      k, l_shipdate, l_partkey, l_suppkey
    FROM (SELECT l_orderkey AS k, {site('l_orderkey')}, l_shipdate, l_partkey, l_suppkey FROM lineitem WHERE l_linenumber % 2 = 1)""",
    "g_calls_last": _last("g_calls", "chromosome, position", "genotype DESC", "chromosome IS NOT NULL"),
    "g_calls_letters": (
        "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY chromosome, position, letter1, letter2 "
        f"ORDER BY {_LINE_ORDER}, genotype DESC) AS rn FROM (SELECT *, substr(genotype, 1, 1) AS letter1, "
        "substr(genotype, 2, 1) AS letter2 FROM g_calls WHERE chromosome IS NOT NULL)) WHERE rn = 1"),
    "g_calls_rsid": _last("g_calls", "rsid", "genotype DESC", "chromosome IS NOT NULL"),
    "g_imputed": f"""
    SELECT CASE WHEN k % 7 = 0 THEN 'chr' || chromosome || ':' || position || ':' || ref_allele || ':' || alt_allele
      ELSE 'rs' || k END AS rsid, * EXCLUDE (k), k FROM (
      SELECT l_orderkey AS k, chromosome, position + CASE WHEN l_orderkey % 23 = 0 THEN 2 ELSE 0 END AS position,
        ref_allele, alt_allele, CAST((l_orderkey * 31 + l_partkey * 7) % 201 AS DOUBLE) / 100 AS dosage,
        CASE WHEN l_orderkey % 29 <> 0 THEN CAST(l_orderkey * 613 % 1000 AS DOUBLE) / 1000 END AS imputation_quality,
        l_shipdate, l_partkey, l_suppkey
      FROM (SELECT *, {site('l_orderkey')} FROM lineitem WHERE l_linenumber % 2 = 0))""",
    "g_imputed_last": _last("g_imputed", "chromosome, position, ref_allele, alt_allele", "dosage DESC"),
    "g_imputed_rsid": _last("g_imputed", "rsid", "dosage DESC"),
    "g_merged": _default(_BY_PLACE),
    "g_merged_rsid": _default(_BY_RSID),
    "g_merged_worker": _merged(
        _BY_LETTERS, "conv IS NOT NULL", dosage_genotype("conv", 0.25, 1.25), "NULL", 0.25, 1.25, "0|0", "Imputed",
        "imputation_quality", ""),
    "g_merged_library": _merged(
        _BY_PLACE, "conv IS NOT NULL AND imputed_dosage IS NOT NULL", "call_genotype", "imputed_r2", 0.5, 1.5, "./.",
        "ImputedLowQual", "NULL", "chr"),
    "g_single_all": f"""
    SELECT i.rsid, i.chromosome, i.position, i.ref_allele, i.alt_allele, coalesce(conv, i.dosage) AS dosage,
      CASE WHEN conv IS NOT NULL THEN 'Genotyped' WHEN i.imputation_quality < 0.3 THEN 'ImputedLowQual' ELSE 'Imputed' END AS source,
      CASE WHEN conv IS NULL THEN i.imputation_quality END AS imputation_quality,
      conv IS NOT NULL OR i.imputation_quality IS NULL OR i.imputation_quality >= 0.9 AS kept
    FROM (SELECT i.*, {call_dosage('c.genotype', 'i.ref_allele', 'i.alt_allele')} AS conv
          FROM g_imputed i LEFT JOIN g_calls_last c ON c.chromosome = i.chromosome AND c.position = i.position) i""",
    "g_single": "SELECT * EXCLUDE (kept) FROM g_single_all WHERE kept",
    "g_long": _long("g_merged"),
    "g_pgs": "SELECT CAST(c_custkey AS VARCHAR) AS sample_id, c_mktsegment AS label, c_acctbal AS value FROM customer",
    "g_pgs_scaled": """
    SELECT sample_id, label, value, CASE WHEN stddev_pop(value) OVER w > 0 AND min(value) OVER w < max(value) OVER w
      THEN (value - avg(value) OVER w) / stddev_pop(value) OVER w ELSE 0 END AS z
    FROM g_pgs WINDOW w AS (PARTITION BY label)""",
    "g_weights": f"""
    SELECT p_brand AS trait, 'rs' || p_partkey AS rsid, p_partkey AS k, chromosome, position,
      CASE WHEN p_partkey % 2 = 1 THEN alt_allele ELSE ref_allele END AS effect_allele,
      CASE WHEN p_partkey % 2 = 1 THEN ref_allele ELSE alt_allele END AS other_allele,
      CAST(p_size - 25 AS DOUBLE) / 1000 AS weight, CAST(p_partkey * 7919 % 1000 + 1 AS DOUBLE) / 1000000000 AS p_value
    FROM (SELECT *, {site('p_partkey')} FROM part)""",
    "g_jobs": """
    SELECT * EXCLUDE (cust), CASE WHEN status IN ('completed', 'expired') THEN completed_at + INTERVAL 86400 SECOND END AS expires_at,
      CASE WHEN id % 7 > 0 THEN completed_at + INTERVAL (id % 100) SECOND END AS last_download_attempt,
      CASE WHEN status = 'completed' AND id % 3 <> 0 THEN completed_at + INTERVAL 60 SECOND END AS emailed_at,
      CASE WHEN cust % 10 <> 0 THEN 'user' || cust || '@example.org' END AS user_email,
      CAST(id % 7 AS INTEGER) AS download_attempts, 5 AS max_download_attempts
    FROM (SELECT *, CASE WHEN status IN ('completed', 'failed', 'expired') THEN started_at + INTERVAL (id * 7 % 7200) SECOND END AS completed_at
      FROM (SELECT *, CASE WHEN status <> 'pending' THEN created_at + INTERVAL (id % 7200) SECOND END AS started_at
        FROM (SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS user_id, o_custkey AS cust, o_orderdate AS created_at,
          CASE WHEN o_orderkey % 50 = 0 THEN 'pending' WHEN o_orderkey % 50 = 1 THEN 'expired' WHEN o_orderstatus = 'F' THEN 'completed'
            WHEN o_orderstatus = 'O' THEN 'processing' ELSE 'failed' END AS status FROM orders)))""",
    "g_attempts": """
    SELECT event_id AS id, user_id AS job_id, ts AS attempted_at, '10.0.0.' || (event_id % 250) AS ip_address,
      CASE event_type WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'invalid_password' WHEN 'click' THEN 'max_attempts_exceeded'
        WHEN 'view' THEN 'rate_limited' ELSE 'job_expired' END AS attempt_result, event_id % 3 <> 0 AS password_valid FROM events""",
    "g_audit": """
    SELECT event_id AS id, ts AS timestamp, CASE event_type WHEN 'error' THEN 'login_failure' WHEN 'click' THEN 'access_denied'
        WHEN 'view' THEN 'file_uploaded' WHEN 'signup' THEN 'job_failed' ELSE 'job_completed' END AS event_type,
      CAST(user_id AS VARCHAR) AS user_id,
      CASE event_id % 4 WHEN 0 THEN 'info' WHEN 1 THEN 'warning' WHEN 2 THEN 'error' ELSE 'critical' END AS severity FROM events""",
    "g_files": """
    SELECT l_orderkey AS job_id, CASE l_linenumber WHEN 1 THEN 'genome_' || l_orderkey || '.txt'
        WHEN 2 THEN 'chr' || (l_partkey % 24 + 1) || '.dose.vcf.gz' WHEN 3 THEN 'scores.txt'
        WHEN 4 THEN '../my file_' || l_suppkey || '.VCF.GZ' WHEN 5 THEN 'index.vcf.gz.tbi' WHEN 6 THEN '.hidden.txt' ELSE 'notes.pgs' END AS file_name,
      CASE l_linenumber WHEN 1 THEN 'Genome' WHEN 2 THEN 'VCF' WHEN 3 THEN 'pgs' WHEN 5 THEN 'vcf_index' ELSE 'result' END AS file_type,
      CAST(floor(l_extendedprice * 3000) AS BIGINT) AS length FROM lineitem""",
}

_NAME = re.compile(r"\bg_[a-z_]+\b")


def _needed(sql: str, seen: list[str]) -> None:
    for name in _NAME.findall(sql):
        if name in VIEWS and name not in seen:
            _needed(VIEWS[name], seen)
            seen.append(name)


def with_views(sql: str) -> str:
    """The query with the views it uses, directly or not, as common table expressions."""
    seen: list[str] = []
    _needed(sql, seen)
    sql = sql.strip()
    if not seen:
        return sql
    views = "WITH " + ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in seen)
    return views + (", " + sql.removeprefix("WITH ") if sql.startswith("WITH ") else "\n" + sql)
