"""Queries over joins, merges and what is written from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from locusloom.functions.text import safe_file_name
from locusloom.operators import compare, queries, stats
from locusloom.operators.merge import (
    DEFAULT_RULES,
    LIBRARY_RULES,
    WORKER_RULES,
    join_user_data,
    merge_counters,
    merge_single_sample,
    single_sample_candidates,
    single_sample_counters,
    to_long,
    with_samples,
)
from locusloom.operators.panel_store import merge_stored, store_panel
from locusloom.plans.derived import CALL_ORDER
from locusloom.plans.registry import merged, query, r6, rounded
from locusloom.schemas import SITE_KEY
from locusloom.session import stage
from locusloom.sinks import tables, vcf

_COMPACT = (
    "rsid, chromosome, position, ref_allele, alt_allele, allele_freq, minor_allele_freq, is_typed, panel_quality, "
    "user_genotype, user_dosage, user_source, user_quality, user_observed")
_CELLS = "JOIN (SELECT k, string_agg(genotype, ',' ORDER BY i) AS cells FROM g_panel_samples GROUP BY k) s USING (k)"


def _flat(df):
    return df.withColumn("cells", F.array_join("sample_genotypes", ",")).drop("sample_genotypes")


# -- merges ----------------------------------------------------------------------------

@query("merge_multi_sample", f"SELECT {_COMPACT}, cells FROM g_merged {_CELLS}")
def _(t):
    return _flat(merged(t))


@query("merge_worker_rules", f"SELECT {_COMPACT} FROM g_merged_worker")
def _(t):
    return merged(t, WORKER_RULES).drop("sample_genotypes")


@query("merge_stored_panel", f"SELECT {_COMPACT}, cells FROM g_merged {_CELLS}")
def _(t):
    return _flat(merge_stored(store_panel(t.panel()), t.calls(), t.imputed(), DEFAULT_RULES, CALL_ORDER, CALL_ORDER))


@query("merge_library_rules", f"SELECT {_COMPACT} FROM g_merged_library")
def _(t):
    return merged(t, LIBRARY_RULES).drop("sample_genotypes")


@query("merge_by_rsid", f"SELECT {_COMPACT} FROM g_merged_rsid")
def _(t):
    return merged(t, DEFAULT_RULES.with_(key="rsid")).drop("sample_genotypes")


@query("merge_single_sample", """
SELECT rsid, chromosome, position, ref_allele, alt_allele, dosage, source, imputation_quality FROM g_single""")
def _(t):
    return merge_single_sample(t.imputed(), t.calls(), 0.9, CALL_ORDER)


@query("merge_counters", """
SELECT p.chromosome, coalesce(genotyped, 0) AS genotyped, coalesce(imputed, 0) AS imputed, coalesce(absent, 0) AS absent, filtered, coalesce(total, 0) AS total
FROM (SELECT chromosome, count(*) FILTER (WHERE imputation_quality < 0.9) AS filtered FROM g_panel GROUP BY 1) p
LEFT JOIN (SELECT chromosome, count(*) AS total, count(*) FILTER (WHERE user_source = 'Genotyped') AS genotyped,
  count(*) FILTER (WHERE user_observed AND user_source <> 'Genotyped') AS imputed, count(*) FILTER (WHERE NOT user_observed) AS absent
  FROM g_merged GROUP BY 1) m USING (chromosome)""")
def _(t):
    return merge_counters(t.panel(), merged(t))


@query("single_sample_counters", """
SELECT chromosome, count(*) FILTER (WHERE kept AND source = 'Genotyped') AS genotyped, count(*) FILTER (WHERE kept AND source <> 'Genotyped') AS imputed,
  count(*) FILTER (WHERE NOT kept) AS filtered, count(*) FILTER (WHERE kept) AS total FROM g_single_all GROUP BY 1""")
def _(t):
    return single_sample_counters(single_sample_candidates(t.imputed(), t.calls(), 0.9, CALL_ORDER))


@query("panel_join_user", """
SELECT p.chromosome, p.position, p.ref_allele, p.alt_allele, c.genotype AS call_genotype, i.dosage AS imputed_dosage, i.imputation_quality AS imputed_r2
FROM g_panel p LEFT JOIN g_calls_last c ON c.chromosome = p.chromosome AND c.position = p.position
LEFT JOIN g_imputed_last i ON i.chromosome = p.chromosome AND i.position = p.position AND i.ref_allele = p.ref_allele AND i.alt_allele = p.alt_allele""")
def _(t):
    joined = join_user_data(t.panel(), t.calls(), t.imputed(), DEFAULT_RULES.with_(panel_min_r2=None), CALL_ORDER, CALL_ORDER)
    return joined.select(*SITE_KEY, "call_genotype", "imputed_dosage", "imputed_r2")


@query("panel_join_calls_by_letters", """
SELECT p.chromosome, p.position, p.ref_allele, p.alt_allele, c.genotype AS call_genotype FROM g_panel p
JOIN g_calls_letters c ON c.chromosome = p.chromosome AND c.position = p.position AND c.letter1 = p.ref_allele AND c.letter2 = p.alt_allele
WHERE p.imputation_quality IS NULL OR p.imputation_quality >= 0.9""")
def _(t):
    joined = join_user_data(t.panel(), t.calls(), t.imputed(), WORKER_RULES, CALL_ORDER, CALL_ORDER)
    return joined.filter(F.col("call_genotype").isNotNull()).select(*SITE_KEY, "call_genotype")


@query("panel_quality_filter", """
SELECT chromosome, count(*) AS variants, count(*) FILTER (WHERE imputation_quality IS NULL) AS unknown_quality FROM g_panel
WHERE imputation_quality IS NULL OR imputation_quality >= 0.8 GROUP BY 1""")
def _(t):
    kept = queries.filtered_export(t.panel(), None, 0.8)
    return kept.groupBy("chromosome").agg(F.count("*").alias("variants"), F.count_if(F.col("imputation_quality").isNull()).alias("unknown_quality"))


# -- forms of the merged frame ---------------------------------------------------------

@query("samples_array", """
SELECT m.chromosome, m.position, s.cells || ',' || m.user_genotype AS genotypes, s.dosage_sum + m.user_dosage AS dosage_sum, m.user_source AS last_source
FROM g_merged m JOIN (SELECT k, string_agg(genotype, ',' ORDER BY i) AS cells,
  CAST(sum(CAST(left(genotype, 1) AS INTEGER) + CAST(right(genotype, 1) AS INTEGER)) AS DOUBLE) AS dosage_sum FROM g_panel_samples GROUP BY k) s USING (k)""")
def _(t):
    wide = with_samples(merged(t))
    return wide.select(
        "chromosome", "position", F.array_join("samples.genotype", ",").alias("genotypes"),
        F.aggregate("samples.dosage", F.lit(0.0), lambda a, x: a + x).alias("dosage_sum"), F.element_at("samples", -1)["source"].alias("last_source"))


@query("long_table", """
SELECT rsid, chromosome, position, ref_allele, alt_allele, allele_freq, minor_allele_freq, is_typed, sample_id, genotype, dosage, source, imputation_quality FROM g_long""")
def _(t):
    return to_long(merged(t))


@query("long_totals", """
SELECT sample_id, source, count(*) AS variants, round(sum(dosage), 6) AS dosage_sum, count(imputation_quality) AS with_quality FROM g_long GROUP BY 1, 2""")
def _(t):
    return to_long(merged(t)).groupBy("sample_id", "source").agg(
        F.count("*").alias("variants"), r6(F.sum("dosage")).alias("dosage_sum"), F.count("imputation_quality").alias("with_quality"))


@query("wide_genotypes", """
SELECT m.rsid, m.chromosome, m.position, m.ref_allele, m.alt_allele, m.allele_freq, m.minor_allele_freq, m.is_typed, m.panel_quality, m.user_source, s.*, m.user_genotype AS samp51
FROM g_merged m JOIN (SELECT """ + ", ".join(f"max(genotype) FILTER (WHERE i = {i}) AS samp{i}" for i in range(1, 51)) + """, k AS site_k
  FROM g_panel_samples GROUP BY k) s ON s.site_k = m.k""")
def _(t):
    rows = merged(t)
    wide = queries.wide_genotypes(rows)
    return wide.withColumn("site_k", ((F.col("position") - 10000) / 37).cast("bigint"))


@query("pivot_samples", """
SELECT chromosome, position, ref_allele, alt_allele, max(dosage) FILTER (WHERE sample_id = 'samp1') AS samp1,
  max(dosage) FILTER (WHERE sample_id = 'samp2') AS samp2, max(dosage) FILTER (WHERE sample_id = 'samp51') AS samp51 FROM g_long GROUP BY 1, 2, 3, 4""")
def _(t):
    return stats.pivot_samples_of_rows(merged(t), ["samp1", "samp2", "samp51"])


_SAMPLES = [f"samp{i}" for i in range(1, 52)]


@query("pivot_all_samples", "SELECT chromosome, position, ref_allele, alt_allele, " + ", ".join(
    f"max(dosage) FILTER (WHERE sample_id = '{s}') AS {s}" for s in _SAMPLES) + " FROM g_long GROUP BY 1, 2, 3, 4")
def _(t):
    return stats.pivot_samples_of_rows(merged(t), _SAMPLES)


# -- sinks as rows ---------------------------------------------------------------------

_LINE = """'chr' || m.chromosome || chr(9) || m.position || chr(9) || m.rsid || chr(9) || m.ref_allele || chr(9) || m.alt_allele || chr(9) || '.' || chr(9) || '.' || chr(9) || """


@query("vcf_lines", f"""
SELECT m.chromosome, m.position, m.ref_allele, m.alt_allele, {_LINE} printf('AF=%.4f;MAF=%.4f', allele_freq, minor_allele_freq) || CASE WHEN is_typed THEN ';TYPED' ELSE '' END
  || chr(9) || 'GT:DS:IQ' || chr(9) || s.cells || chr(9) || user_genotype || ':' || printf('%.3f', user_dosage) || ':' || coalesce(printf('%.3f', user_quality), '.') AS value
FROM g_merged m JOIN (SELECT p.k, string_agg(genotype || ':' || (CAST(left(genotype, 1) AS INTEGER) + CAST(right(genotype, 1) AS INTEGER)) || '.000:'
    || coalesce(printf('%.3f', imputation_quality), '.'), chr(9) ORDER BY i) AS cells
  FROM g_panel p JOIN g_panel_samples USING (k) GROUP BY p.k) s USING (k)""")
def _(t):
    return vcf.multi_sample_lines(merged(t))


@query("vcf_lines_single_sample", f"""
SELECT m.chromosome, m.position, m.ref_allele, m.alt_allele, {_LINE} printf('DS=%.3f', dosage) || coalesce(printf(';IQ=%.3f', imputation_quality), '') || ';SRC=' || source AS value FROM g_single m""")
def _(t):
    return vcf.single_sample_lines(merge_single_sample(t.imputed(), t.calls(), 0.9, CALL_ORDER))


@query("vcf_lines_biallelic_snps", """
SELECT chromosome, count(*) AS vcf_rows, min(position) AS first_position, max(position) AS last_position FROM g_merged
WHERE length(ref_allele) = 1 AND length(alt_allele) = 1 GROUP BY 1""")
def _(t):
    lines = vcf.multi_sample_lines(queries.biallelic_snps(merged(t)))
    return lines.groupBy("chromosome").agg(F.count("value").alias("vcf_rows"), F.min("position").alias("first_position"), F.max("position").alias("last_position"))


@query("variant_json", """
SELECT chromosome, position, rsid, CAST(51 AS INTEGER) AS samples, user_genotype AS last_genotype, user_dosage AS last_dosage, user_quality IS NOT NULL AS has_quality FROM g_merged""")
def _(t):
    schema = "rsid string, samples array<struct<sample_id:string,genotype:string,dosage:double,source:string,imputation_quality:double>>"
    rows = tables.variant_json(merged(t)).select("chromosome", "position", F.from_json("value", schema).alias("d"), "value")
    last = F.element_at("d.samples", -1)
    return rows.select("chromosome", "position", "d.rsid", F.size("d.samples").alias("samples"), last["genotype"].alias("last_genotype"),
                       last["dosage"].alias("last_dosage"), F.substring_index("value", "samp51", -1).contains("imputation_quality").alias("has_quality"))


@query("relational_variants", """
SELECT chromosome, sample_id, count(*) AS variants, round(sum(dosage), 6) AS dosage_sum FROM g_long GROUP BY 1, 2""")
def _(t):
    # Every merged row twice: the key keeps one.
    rows = stage(merged(t), "merged")
    frames = tables.relational_frames(rows.unionAll(rows), _metadata(t), staged=True)
    return frames["variants"].groupBy("chromosome", "sample_id").agg(F.count("*").alias("variants"), r6(F.sum("dosage")).alias("dosage_sum"))


def _metadata(t):
    return tables.run_metadata(stats.run_statistics(merged(t)), "job-1", "user-1", "2025-01-01T00:00:00Z")


@query("metadata_rows", """
WITH n AS (SELECT count(*) AS total, count(*) FILTER (WHERE is_typed) AS typed, count(*) FILTER (WHERE user_source = 'ImputedLowQual') AS low FROM g_merged)
SELECT 'job_id' AS key, 'job-1' AS value UNION ALL SELECT 'user_id', 'user-1' UNION ALL SELECT 'processing_date', '2025-01-01T00:00:00Z'
UNION ALL SELECT 'genome_file', 'array genotype calls' UNION ALL SELECT 'imputation_server', 'imputed VCF'
UNION ALL SELECT 'reference_panel', '50 panel samples + user (1 sample) = 51 total'
UNION ALL SELECT 'total_snps', CAST(total AS VARCHAR) FROM n UNION ALL SELECT 'genotyped_snps', CAST(typed AS VARCHAR) FROM n
UNION ALL SELECT 'imputed_snps', CAST(total - typed AS VARCHAR) FROM n UNION ALL SELECT 'low_quality_snps', CAST(low AS VARCHAR) FROM n""")
def _(t):
    return tables.metadata_rows(_metadata(t))


@query("filtered_export", """
SELECT rsid, chromosome, position, sample_id, dosage FROM g_long WHERE chromosome IN (1, 2, 3) AND (imputation_quality IS NULL OR imputation_quality >= 0.95) AND source = 'Genotyped'""")
def _(t):
    long = queries.filtered_export(to_long(merged(t)), [1, 2, 3], 0.95, True)
    return long.select("rsid", "chromosome", "position", "sample_id", "dosage")


@query("run_summary", """
SELECT c.chromosome, total, genotyped, f.file_type, f.files FROM
  (SELECT chromosome, count(*) AS total, count(*) FILTER (WHERE user_source = 'Genotyped') AS genotyped FROM g_merged GROUP BY 1) c,
  (SELECT file_type, count(*) AS files FROM g_files GROUP BY 1) f""")
def _(t):
    document = tables.run_summary(merge_counters(t.panel(), merged(t)), t.files())
    schema = "chromosomes array<struct<chromosome:int,total:bigint,genotyped:bigint>>, outputs array<struct<file_type:string,files:bigint>>"
    rows = document.select(F.from_json("summary", schema).alias("d")).select(F.explode("d.chromosomes").alias("c"), "d.outputs")
    return rows.select("c.*", F.explode("outputs").alias("f")).select("chromosome", "total", "genotyped", "f.*")


# -- look-ups --------------------------------------------------------------------------

@query("lookup_rsid", """
SELECT rsid, chromosome_text AS chromosome, position, genotype, coalesce(genotype ~ '^[ACGT]{2}$' AND substr(genotype, 1, 1) <> substr(genotype, 2, 1), FALSE) AS is_heterozygous
FROM g_calls WHERE rsid IN ('rs1', 'rs2', 'rs3', 'rs5', 'rs8', 'rs13')""")
def _(t):
    return queries.lookup_rsid(t.calls(), ["rs1", "rs2", "rs3", "rs5", "rs8", "rs13"]).drop(*CALL_ORDER)


@query("high_dosage", "SELECT rsid, chromosome, position, dosage FROM g_long WHERE sample_id = 'samp51' AND dosage > 1.5")
def _(t):
    return queries.high_dosage(to_long(merged(t)), "samp51").select("rsid", "chromosome", "position", "dosage")


@query("rare_variants", "SELECT rsid, chromosome, position, allele_freq FROM g_merged WHERE allele_freq < 0.01")
def _(t):
    return queries.rare_variants(merged(t)).select("rsid", "chromosome", "position", "allele_freq")


@query("region_page", """
WITH r AS (SELECT rsid, chromosome, position, ref_allele, alt_allele, user_dosage FROM g_merged
  WHERE chromosome = 3 AND position BETWEEN 20000 AND 200000 AND (user_quality IS NULL OR user_quality >= 0.5))
SELECT *, (SELECT count(*) FROM r) AS total_count FROM (SELECT * FROM r ORDER BY position, ref_allele, alt_allele LIMIT 20 OFFSET 20)""")
def _(t):
    rows = queries.region(merged(t), 3, 20000, 200000, 0.5).select("rsid", *SITE_KEY, "user_dosage")
    return queries.page(rows, ["position", "ref_allele", "alt_allele"], 2, 20)


@query("preview", "SELECT chromosome, position, rsid FROM g_merged ORDER BY chromosome, position LIMIT 10")
def _(t):
    return queries.preview(merged(t).select("chromosome", "position", "rsid").orderBy("chromosome", "position"))


@query("best_per_rsid", """
SELECT rsid, chromosome, position, ref_allele, alt_allele, imputation_quality FROM (
  SELECT *, row_number() OVER (PARTITION BY rsid ORDER BY imputation_quality DESC NULLS LAST, chromosome, position, ref_allele, alt_allele) AS rn
  FROM (SELECT 'rs' || (k // 2) AS rsid, chromosome, position, ref_allele, alt_allele, imputation_quality FROM g_imputed)) WHERE rn = 1""")
def _(t):
    k = F.floor((F.col("position") - 10000) / 37 / 2).cast("bigint")
    rows = t.imputed().select(F.concat(F.lit("rs"), k.cast("string")).alias("rsid"), *SITE_KEY, "imputation_quality")
    return queries.best_per_rsid(rows)


@query("annotate_calls", """
SELECT c.rsid, c.genotype, p.ref_allele, p.alt_allele, p.minor_allele_freq, count(*) AS calls FROM g_calls c LEFT JOIN g_panel p ON p.rsid = c.rsid GROUP BY ALL""")
def _(t):
    rows = queries.annotate_calls(t.calls(), t.panel())
    return rows.groupBy("rsid", "genotype", "ref_allele", "alt_allele", "minor_allele_freq").agg(F.count("*").alias("calls"))


@query("genotypes_of_user", """
SELECT label, count(*) AS scores, round(sum(value), 2) AS value_sum FROM g_pgs WHERE sample_id IN (SELECT user_id FROM g_jobs WHERE status = 'failed' AND user_id IS NOT NULL)
AND sample_id IN (SELECT CAST(o_custkey AS VARCHAR) FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY 1""")
def _(t):
    failed = t.jobs().filter("status = 'failed'").select(F.col("user_id").alias("sample_id"))
    urgent = t.base("orders").select(F.col("o_custkey").cast("string").alias("sample_id"), F.col("o_orderpriority").alias("user_id"))
    mine = queries.genotypes_of_user(t.pgs().join(failed, "sample_id", "left_semi"), urgent, "1-URGENT")
    return mine.groupBy("label").agg(F.count("*").alias("scores"), F.round(F.sum("value"), 2).alias("value_sum"))


@query("rows_of_user", "SELECT id, user_id, status FROM g_jobs WHERE user_id = '7'")
def _(t):
    return queries.rows_of_user(t.jobs(), "7").select("id", "user_id", "status")


# -- comparisons -----------------------------------------------------------------------

@query("compare_runs", """
SELECT coalesce(a.chromosome, b.chromosome) AS chromosome, coalesce(n_a, 0) AS rows_a, coalesce(n_b, 0) AS rows_b,
  coalesce(n_b, 0) - coalesce(n_a, 0) AS difference, round(CAST(coalesce(n_b, 0) AS DOUBLE) / coalesce(n_a, 0), 6) AS ratio
FROM (SELECT chromosome, count(*) AS n_a FROM g_merged GROUP BY 1) a FULL JOIN (SELECT chromosome, count(*) AS n_b FROM g_single GROUP BY 1) b ON a.chromosome = b.chromosome""")
def _(t):
    return rounded(compare.compare_counts(merged(t), merge_single_sample(t.imputed(), t.calls(), 0.9, CALL_ORDER)), "ratio")


_A = "(SELECT DISTINCT chromosome, position, ref_allele, alt_allele FROM g_merged)"
_B = "(SELECT DISTINCT chromosome, position, ref_allele, alt_allele FROM g_imputed)"


@query("key_overlap", f"""
SELECT (SELECT count(*) FROM (FROM {_A} EXCEPT FROM {_B})) AS only_a, (SELECT count(*) FROM (FROM {_B} EXCEPT FROM {_A})) AS only_b,
  (SELECT count(*) FROM (FROM {_A} INTERSECT FROM {_B})) AS both""")
def _(t):
    return compare.key_overlap(merged(t), t.imputed())


@query("only_in_first_run", f"""
SELECT chromosome, position, ref_allele, alt_allele, user_dosage FROM g_merged m
WHERE NOT EXISTS (SELECT 1 FROM g_imputed i WHERE i.chromosome = m.chromosome AND i.position = m.position AND i.ref_allele = m.ref_allele AND i.alt_allele = m.alt_allele)""")
def _(t):
    return compare.only_in_first(merged(t), t.imputed()).select(*SITE_KEY, "user_dosage")


@query("in_both_runs", f"FROM {_A} INTERSECT FROM {_B}")
def _(t):
    return compare.in_both(merged(t), t.imputed())


@query("dosage_agreement", """
SELECT count(*) AS shared, count(*) FILTER (WHERE abs(a.user_dosage - b.user_dosage) <= 0.001) AS within_tolerance, max(abs(a.user_dosage - b.user_dosage)) AS largest_difference
FROM g_merged a JOIN g_merged_worker b USING (chromosome, position, ref_allele, alt_allele)""")
def _(t):
    return compare.dosage_agreement(merged(t), merged(t, WORKER_RULES))


@query("quality_report", """
SELECT 'chromosomes_missing' AS rule, 22 - count(DISTINCT chromosome) AS violations FROM g_panel
UNION ALL SELECT 'panel_duplicate_ids', count(rsid) - count(DISTINCT rsid) FROM g_panel
UNION ALL SELECT 'dosage_out_of_range', count(*) FILTER (WHERE dosage < 0 OR dosage > 2) FROM g_imputed
UNION ALL SELECT 'alleles_not_acgt', 0 UNION ALL SELECT 'call_shape', 0
UNION ALL SELECT 'weight_duplicate_sites', count(*) - count(DISTINCT (trait, chromosome, position)) FROM g_weights
UNION ALL SELECT 'traits_below_coverage', count(*) FROM (SELECT trait FROM g_weights w LEFT JOIN g_merged m USING (chromosome, position)
  GROUP BY trait HAVING count(m.rsid) < count(*) * 0.5)""")
def _(t):
    return compare.quality_report(t.panel(), t.imputed(), t.calls(), t.weights(), merged(t))


@query("safe_file_names", """
SELECT file_name, left(regexp_replace(regexp_replace(file_name, '[/\\\\]', '_', 'g'), '[^A-Za-z0-9_.-]', '', 'g'), 255) AS safe_name, count(*) AS files FROM g_files GROUP BY ALL""")
def _(t):
    rows = t.files().select("file_name", safe_file_name("file_name").alias("safe_name"))
    return rows.groupBy("file_name", "safe_name").agg(F.count("*").alias("files"))
