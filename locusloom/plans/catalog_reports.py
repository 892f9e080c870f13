"""Queries over counts, distributions, scores and weighted scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from locusloom.functions.genotype import genotype_text_dosage
from locusloom.functions.numeric import normal_cdf
from locusloom.operators import pgs, scoring, stats
from locusloom.operators.merge import merge_single_sample, to_long, unique_calls
from locusloom.plans.derived import CALL_ORDER
from locusloom.plans.registry import merged, query, r6, rounded
from locusloom.session import stage

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


# -- merged frames ---------------------------------------------------------------------

@query("run_statistics", """
SELECT count(*) AS total, count(*) FILTER (WHERE is_typed) AS genotyped, count(*) FILTER (WHERE NOT is_typed) AS imputed,
  count(*) FILTER (WHERE user_source = 'ImputedLowQual') AS low_quality FROM g_merged""")
def _(t):
    return stats.run_statistics(merged(t))


@query("run_statistics_by_chromosome", """
SELECT chromosome, count(*) AS total, count(*) FILTER (WHERE is_typed) AS genotyped, count(*) FILTER (WHERE NOT is_typed) AS imputed,
  count(*) FILTER (WHERE user_source = 'ImputedLowQual') AS low_quality FROM g_merged GROUP BY 1""")
def _(t):
    return stats.run_statistics(merged(t), ["chromosome"])


@query("single_sample_statistics", """
SELECT count(*) AS total, count(*) FILTER (WHERE source = 'Genotyped') AS genotyped, count(*) FILTER (WHERE source <> 'Genotyped') AS imputed,
  count(*) FILTER (WHERE source = 'ImputedLowQual') AS low_quality FROM g_single""")
def _(t):
    return stats.single_sample_statistics(merge_single_sample(t.imputed(), t.calls(), 0.9, CALL_ORDER))


@query("user_genotyped_counts", """
SELECT chromosome, count(*) AS variants, count(*) FILTER (WHERE user_source = 'Genotyped') AS user_genotyped FROM g_merged GROUP BY ROLLUP (chromosome)""")
def _(t):
    return stats.user_genotyped_counts(merged(t))


@query("ideogram_counts", """
SELECT chromosome, count(*) FILTER (WHERE user_source = 'Genotyped') AS genotyped,
  count(*) FILTER (WHERE user_source <> 'Genotyped' AND user_quality >= 0.8) AS imputed_high_quality,
  count(*) FILTER (WHERE user_source <> 'Genotyped' AND NOT coalesce(user_quality >= 0.8, FALSE)) AS imputed_low_quality FROM g_merged GROUP BY 1""")
def _(t):
    return stats.ideogram_counts(merged(t))


@query("genotyped_positions", "SELECT chromosome, position, rsid FROM g_merged WHERE chromosome = 5 AND user_source = 'Genotyped'")
def _(t):
    return stats.genotyped_positions(merged(t), 5)


@query("sample_metrics", """
SELECT count(*) FILTER (WHERE user_source = 'Genotyped') AS snp_count_genotyped, count(*) FILTER (WHERE user_source <> 'Genotyped') AS snp_count_imputed,
  count(*) AS snp_count_total, round(avg(user_quality), 6) AS mean_imputation_quality FROM g_merged""")
def _(t):
    return rounded(stats.sample_metrics(merged(t)), "mean_imputation_quality")


@query("match_metrics", """
SELECT chromosome, count(*) AS variants,
  round(100.0 * (SELECT count(*) FROM g_calls_last c WHERE c.chromosome = m.chromosome AND regexp_full_match(c.genotype, '[ACGT][ACGT]')
      AND EXISTS (SELECT 1 FROM g_merged x WHERE x.chromosome = c.chromosome AND x.position = c.position AND x.user_source = 'Genotyped'))
    / (SELECT count(*) FROM g_calls_last c WHERE c.chromosome = m.chromosome AND regexp_full_match(c.genotype, '[ACGT][ACGT]')), 6) AS match_rate,
  round(avg(user_quality), 6) AS mean_quality, count(*) FILTER (WHERE user_quality >= 0.9) AS quality_090,
  count(*) FILTER (WHERE user_quality >= 0.8 AND user_quality < 0.9) AS quality_080,
  count(*) FILTER (WHERE user_quality >= 0.3 AND user_quality < 0.8) AS quality_030, count(*) FILTER (WHERE user_quality < 0.3) AS quality_low
FROM g_merged m GROUP BY chromosome""")
def _(t):
    calls = unique_calls(t.calls(), ["chromosome", "position"], CALL_ORDER)
    return rounded(stats.match_metrics(merged(t), calls), "match_rate", "mean_quality")


@query("panel_mean_dosage", """
SELECT rsid, chromosome, position, ref_allele, alt_allele, round(d / 50, 6) AS mean_dosage, round(d / 100, 6) AS panel_frequency
FROM g_merged JOIN (SELECT k, CAST(sum(CAST(left(genotype, 1) AS INTEGER) + CAST(right(genotype, 1) AS INTEGER)) AS DOUBLE) AS d FROM g_panel_samples GROUP BY k) s USING (k)""")
def _(t):
    return rounded(stats.panel_mean_dosage(merged(t), genotype_text_dosage), "mean_dosage", "panel_frequency")


# -- long table ------------------------------------------------------------------------

@query("mean_dosage", "SELECT rsid, chromosome, position, ref_allele, alt_allele, round(avg(dosage), 6) AS mean_dosage FROM g_long GROUP BY 1, 2, 3, 4, 5")
def _(t):
    return rounded(stats.mean_dosage_of_rows(merged(t)), "mean_dosage")


@query("panel_frequency", """
SELECT chromosome, position, ref_allele, alt_allele, round(avg(dosage) / 2, 6) AS panel_frequency, min(rsid) AS rsid, max(allele_freq) AS allele_freq
FROM g_long WHERE sample_id <> 'samp51' GROUP BY 1, 2, 3, 4""")
def _(t):
    return rounded(stats.panel_frequency_of_rows(merged(t)), "panel_frequency")


@query("genotype_distribution", """
SELECT chromosome, position, genotype, count(*) AS samples FROM g_long WHERE sample_id <> 'samp51' GROUP BY 1, 2, 3""")
def _(t):
    return stats.genotype_distribution_of_rows(merged(t), ["chromosome", "position"])


@query("dataset_profile", """
SELECT count(DISTINCT (chromosome, position, ref_allele, alt_allele)) AS variants, count(DISTINCT chromosome) AS chromosomes, count(*) AS long_rows,
  CAST(sum(is_typed) AS BIGINT) AS typed_rows, count(DISTINCT sample_id) AS samples FROM g_long""")
def _(t):
    return stats.dataset_profile_of_rows(merged(t))


@query("long_slice", """
SELECT chromosome, sample_id, count(*) AS rows_read, round(avg(dosage), 6) AS mean_dosage FROM g_long WHERE chromosome = 4 GROUP BY 1, 2""")
def _(t):
    long = to_long(merged(t)).filter(F.col("chromosome") == 4)
    return long.groupBy("chromosome", "sample_id").agg(F.count("*").alias("rows_read"), r6(F.avg("dosage")).alias("mean_dosage"))


# -- quality ---------------------------------------------------------------------------

@query("describe_quality", """
SELECT count(q) AS "count", round(avg(q), 6) AS mean, round(stddev_samp(q), 6) AS sd, min(q) AS min, max(q) AS max,
  round(quantile_cont(q, 0.25), 6) AS q25, round(quantile_cont(q, 0.5), 6) AS q50, round(quantile_cont(q, 0.75), 6) AS q75 FROM (SELECT imputation_quality AS q FROM g_imputed)""")
def _(t):
    return rounded(stats.describe_quality(t.imputed()), "mean", "sd", "q25", "q50", "q75")


@query("describe_quality_by_chromosome", """
SELECT chromosome, count(q) AS "count", round(avg(q), 6) AS mean, round(stddev_samp(q), 6) AS sd, min(q) AS min, max(q) AS max,
  round(quantile_cont(q, 0.25), 6) AS q25, round(quantile_cont(q, 0.5), 6) AS q50, round(quantile_cont(q, 0.75), 6) AS q75
FROM (SELECT chromosome, imputation_quality AS q FROM g_imputed) WHERE q IS NOT NULL GROUP BY 1""")
def _(t):
    return rounded(stats.describe_quality(t.imputed(), ["chromosome"]), "mean", "sd", "q25", "q50", "q75")


@query("quality_tiers", """
SELECT chromosome, count(*) AS rows, count(*) FILTER (WHERE q >= 0.9) AS r2_090, count(*) FILTER (WHERE q >= 0.8) AS r2_080, count(*) FILTER (WHERE q >= 0.3) AS r2_030,
  count(*) FILTER (WHERE q < 0.3) AS r2_low, count(*) FILTER (WHERE q IS NULL) AS r2_unknown, round(avg(q), 6) AS mean_r2, min(q) AS min_r2, max(q) AS max_r2
FROM (SELECT chromosome, imputation_quality AS q FROM g_imputed) GROUP BY 1""")
def _(t):
    return rounded(stats.quality_tiers(t.imputed(), ["chromosome"]), "mean_r2")


@query("duplicate_ids", """
SELECT count(*) AS distinct_ids, count(*) FILTER (WHERE n > 1) AS repeated_ids, CAST(sum(n - 1) AS BIGINT) AS extra_rows
FROM (SELECT rsid, count(*) AS n FROM g_calls GROUP BY 1)""")
def _(t):
    return stats.duplicate_ids(t.calls())


# -- array calls -----------------------------------------------------------------------

_CALLS = """(SELECT *, genotype ~ '^[ACGT]{2}$' AS clean, genotype ~ '^[ACGT]{2}$' AND substr(genotype, 1, 1) <> substr(genotype, 2, 1) AS het,
  genotype IN ('AG', 'GA', 'CT', 'TC') AS ts, length(genotype) - length(replace(genotype, 'A', '')) AS a, length(genotype) - length(replace(genotype, 'C', '')) AS c,
  length(genotype) - length(replace(genotype, 'G', '')) AS g, length(genotype) - length(replace(genotype, 'T', '')) AS t FROM g_calls)"""
_SUMMARY = """count(*) AS total, count(*) FILTER (WHERE clean) AS called, count(*) FILTER (WHERE het) AS heterozygous,
  round(CAST(count(*) FILTER (WHERE het) AS DOUBLE) / count(*) FILTER (WHERE clean), 6) AS heterozygosity, count(*) FILTER (WHERE het AND ts) AS transitions,
  count(*) FILTER (WHERE het AND NOT ts) AS transversions, round(CAST(count(*) FILTER (WHERE het AND ts) AS DOUBLE) / count(*) FILTER (WHERE het AND NOT ts), 6) AS ts_tv,
  """ + ", ".join(f"round(CAST(sum({x}) FILTER (WHERE clean) AS DOUBLE) / (2 * count(*) FILTER (WHERE clean)), 6) AS freq_{x}" for x in "acgt")
_SHARES = ["heterozygosity", "ts_tv", "freq_a", "freq_c", "freq_g", "freq_t"]


@query("call_summary", f"SELECT {_SUMMARY} FROM {_CALLS}")
def _(t):
    return rounded(stats.call_summary(t.calls()), *_SHARES)


@query("call_summary_by_chromosome", f"SELECT chromosome_text AS chromosome, count(*) AS total, count(*) FILTER (WHERE het) AS heterozygous, round(CAST(count(*) FILTER (WHERE het) AS DOUBLE) / count(*) FILTER (WHERE clean), 6) AS heterozygosity FROM {_CALLS} GROUP BY 1")
def _(t):
    return rounded(stats.chromosome_summary(t.calls()), "heterozygosity").orderBy(*stats.chromosome_order())


@query("letter_frequencies", f"""
WITH s AS (SELECT {", ".join(f"CAST(sum({x}) FILTER (WHERE clean) AS BIGINT) AS {x}" for x in "acgt")} FROM {_CALLS})
{" UNION ALL ".join(f"SELECT '{x.upper()}' AS letter, {x} AS letters, round(CAST({x} AS DOUBLE) / (a + c + g + t), 6) AS frequency FROM s" for x in "acgt")}""")
def _(t):
    return rounded(stats.letter_frequencies(t.calls()), "frequency").orderBy(F.desc("frequency"), "letter")


# -- scores ----------------------------------------------------------------------------

@query("pgs_zscore", "SELECT sample_id, label, value, round(z, 6) AS z FROM g_pgs_scaled")
def _(t):
    return rounded(pgs.scale_pgs(t.pgs()), "z")


@query("pgs_zscore_sample_sd", """
SELECT sample_id, label, round((value - avg(value) OVER w) / stddev_samp(value) OVER w, 6) AS z FROM g_pgs WINDOW w AS (PARTITION BY label)""")
def _(t):
    return rounded(pgs.scale_pgs(t.pgs(), ddof=1), "z").select("sample_id", "label", "z")


@query("pgs_stats", """
SELECT label, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, min(value) AS min, max(value) AS max FROM g_pgs GROUP BY 1""")
def _(t):
    return rounded(pgs.pgs_stats(t.pgs()), "mean", "sd")


@query("pgs_traits", "SELECT DISTINCT label FROM g_pgs")
def _(t):
    return pgs.trait_labels(t.pgs())


@query("pgs_trait_count", "SELECT count(DISTINCT label) AS traits FROM g_pgs")
def _(t):
    return pgs.trait_count(t.pgs())


@query("pgs_output", "SELECT sample_id, label AS trait_label, round(z, 6) AS value FROM g_pgs_scaled")
def _(t):
    return rounded(pgs.pgs_output(pgs.scale_pgs(t.pgs()), scaled=True), "value")


_SAMPLES = [str(i) for i in range(1, 52)]


@query("pgs_pivot_samples", "SELECT label, " + ", ".join(
    f"round(max(z) FILTER (WHERE sample_id = '{s}'), 6) AS \"{s}\"" for s in _SAMPLES) + " FROM g_pgs_scaled GROUP BY 1")
def _(t):
    return rounded(pgs.pivot_scores(pgs.scale_pgs(t.pgs()), _SAMPLES, "z"), *_SAMPLES)


_CELLS = [f"samp{i}" for i in range(1, 52)]


@query("pgs_pivot_all_samples", "SELECT label, " + ", ".join(
    f"round(avg(z) FILTER (WHERE CAST(sample_id AS BIGINT) % 51 = {i}), 6) + 0.0 AS {s}" for i, s in enumerate(_CELLS)) + " FROM g_pgs_scaled GROUP BY 1")
def _(t):
    # Every customer falls to one of 51 samples; a cell is the mean of its customers, so no score is left out.
    sample = F.concat(F.lit("samp"), (F.col("sample_id").cast("bigint") % 51 + 1).cast("string"))
    cells = pgs.scale_pgs(t.pgs()).groupBy("label", sample.alias("sample_id")).agg(F.avg("z").alias("z"))
    return rounded(pgs.pivot_scores(cells, _CELLS, "z"), *_CELLS)


@query("pgs_pivot_traits", "SELECT sample_id AS sample, " + ", ".join(
    f"max(value) FILTER (WHERE label = '{s}') AS \"{s}\"" for s in SEGMENTS) + " FROM g_pgs GROUP BY 1")
def _(t):
    return pgs.pivot_traits(t.pgs(), SEGMENTS)


@query("pgs_percentile", """
SELECT sample_id, label, value, round(100 * percent_rank() OVER (PARTITION BY label ORDER BY value), 6) AS percentile FROM g_pgs""")
def _(t):
    return rounded(pgs.score_percentile(t.pgs()), "percentile")


@query("pgs_normal_percentile", """
SELECT sample_id, label, round(50 * (1 + CASE WHEN z < 0 THEN -1 ELSE 1 END * (1 - t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-z * z / 2))), 5) AS percentile
FROM (SELECT *, 1 / (1 + 0.3275911 * abs(z) / sqrt(2)) AS t FROM g_pgs_scaled)""")
def _(t):
    return pgs.normal_percentile(pgs.scale_pgs(t.pgs())).select("sample_id", "label", F.round("percentile", 5).alias("percentile"))


@query("pgs_normalised_to_panel", """
SELECT p.sample_id, p.label, round((p.value - s.m) / s.sd, 6) AS z FROM g_pgs p
JOIN (SELECT label, avg(value) AS m, stddev_pop(value) AS sd FROM g_pgs WHERE CAST(sample_id AS BIGINT) % 3 <> 0 GROUP BY 1) s USING (label)""")
def _(t):
    scored = pgs.normalise_to_reference(t.pgs(), F.col("sample_id").cast("bigint") % 3 != 0)
    return rounded(scored.select("sample_id", "label", "z"), "z")


@query("trait_prediction", """
SELECT sample_id, label, round(sqrt(m.r2) * z * m.trait_sd + m.trait_mean, 6) AS predicted FROM g_pgs_scaled
JOIN (SELECT label, 0.0946 + length(label) / 1000.0 AS r2, 3.0 AS trait_sd, CAST(10 + length(label) AS DOUBLE) AS trait_mean FROM g_pgs GROUP BY label) m USING (label)""")
def _(t):
    models = t.pgs().groupBy("label").agg(F.max(F.length("label")).alias("n")).select(
        "label", (F.lit(0.0946) + F.col("n").cast("double") / 1000.0).alias("r2"), F.lit(3.0).alias("trait_sd"), (F.col("n") + 10).cast("double").alias("trait_mean"))
    return rounded(pgs.predict_trait(pgs.scale_pgs(t.pgs()), models).select("sample_id", "label", "predicted"), "predicted")


# -- weighted scoring ------------------------------------------------------------------

_WEIGHTED = """
SELECT trait, sample_id, sum(CASE WHEN effect_allele = alt_allele THEN dosage ELSE 2 - dosage END * weight) AS raw_score, count(*) AS snp_count
FROM (SELECT chromosome, position, ref_allele, alt_allele, sample_id, dosage FROM g_long WHERE sample_id <> 'samp51' AND genotype NOT IN ('./.', '.|.')
  UNION ALL SELECT chromosome, position, ref_allele, alt_allele, 'samp51', user_dosage FROM g_merged WHERE user_observed)
JOIN (SELECT trait, chromosome, position, effect_allele, weight FROM g_weights) w USING (chromosome, position)
WHERE effect_allele IN (ref_allele, alt_allele) GROUP BY 1, 2"""


@query("weights_join", """
SELECT w.trait, m.chromosome, m.position, m.ref_allele, m.alt_allele, w.effect_allele, w.weight, m.user_dosage
FROM g_merged m JOIN g_weights w ON w.chromosome = m.chromosome AND w.position = m.position""")
def _(t):
    return scoring.join_weights(merged(t), t.weights()).select(
        "trait", "chromosome", "position", "ref_allele", "alt_allele", "effect_allele", "weight", "user_dosage")


@query("weights_join_by_rsid", """
SELECT w.trait, m.rsid, w.weight, m.user_dosage FROM g_merged m JOIN g_weights w ON w.rsid = m.rsid""")
def _(t):
    return scoring.join_weights(merged(t), t.weights(), "rsid").select("trait", "rsid", "weight", "user_dosage")


@query("pgs_raw_scores", f"SELECT trait, sample_id, round(raw_score, 6) AS raw_score, snp_count FROM ({_WEIGHTED})")
def _(t):
    return rounded(scoring.raw_scores(merged(t), t.weights()), "raw_score")


@query("pgs_coverage", f"""
SELECT trait, sample_id, snp_count, round(CAST(snp_count AS DOUBLE) / n, 6) AS coverage FROM ({_WEIGHTED})
JOIN (SELECT trait, count(*) AS n FROM g_weights GROUP BY 1) w USING (trait) WHERE CAST(snp_count AS DOUBLE) / n >= 0.4""")
def _(t):
    scores = scoring.with_coverage(scoring.raw_scores(merged(t), t.weights()), t.weights(), 0.4)
    return rounded(scores.select("trait", "sample_id", "snp_count", "coverage"), "coverage")


@query("pgs_results", f"""
WITH s AS (SELECT trait, sample_id, round(raw_score, 6) + 0.0 AS raw_score, snp_count FROM ({_WEIGHTED})), m AS (SELECT trait, avg(raw_score) AS m, stddev_pop(raw_score) AS sd, min(raw_score) AS lo, max(raw_score) AS hi FROM s WHERE sample_id <> 'samp51' GROUP BY 1)
SELECT s.trait, sample_id, raw_score, percentile, round(CASE WHEN sd > 0 AND hi - lo > 1e-12 * greatest(abs(lo), abs(hi)) THEN (raw_score - m) / sd ELSE 0 END, 9) AS normalized_score,
  snp_count, round(CAST(snp_count AS DOUBLE) / n, 6) AS coverage
FROM (SELECT s.trait, s.sample_id, s.raw_score, s.snp_count, round(100.0 * count(*) FILTER (WHERE r.raw_score < s.raw_score) / count(*), 6) AS percentile
  FROM s JOIN s r ON r.trait = s.trait AND r.sample_id <> 'samp51' GROUP BY 1, 2, 3, 4) s
JOIN m USING (trait) JOIN (SELECT trait, count(*) AS n FROM g_weights GROUP BY 1) w USING (trait)""")
def _(t):
    # One score at sf0.01 ends in a 5 at the seventh decimal exactly, so nine are compared.
    results = scoring.pgs_results(merged(t), t.weights(), None).withColumn("normalized_score", F.round("normalized_score", 9) + F.lit(0.0))
    return rounded(results, "percentile", "coverage")


@query("manhattan_series", """
SELECT w.trait, m.chromosome, m.position, m.rsid, w.p_value, w.weight AS beta, m.user_dosage FROM g_merged m
JOIN g_weights w ON w.chromosome = m.chromosome AND w.position = m.position""")
def _(t):
    return scoring.manhattan_series(merged(t), t.weights())


@query("significant_loci", """
SELECT w.trait, count(*) AS points, count(*) FILTER (WHERE w.p_value < 5e-8) AS significant_loci FROM g_merged m
JOIN g_weights w ON w.chromosome = m.chromosome AND w.position = m.position GROUP BY 1""")
def _(t):
    return scoring.significant_loci(scoring.manhattan_series(merged(t), t.weights()))


@query("ancestry_components")
def _(t):
    return scoring.ancestry_components(merged(t))


@query("ancestry_distances", """
SELECT a.sample_id AS sample_a, b.sample_id AS sample_b, round(sqrt(sum((a.dosage - b.dosage) * (a.dosage - b.dosage))), 3) AS distance
FROM g_long a JOIN g_long b USING (chromosome, position, ref_allele, alt_allele) WHERE a.sample_id <> b.sample_id GROUP BY 1, 2""")
def _(t):
    """All components together, so that their distances are those of the dosages."""
    # Staged: 51 rows, read twice.
    components = stage(scoring.ancestry_components(merged(t), 51), "components")
    return scoring.ancestry_distances(components).withColumn("distance", F.round("distance", 3))


@query("normal_cdf_table", """
SELECT c_custkey, round(0.5 * (1 + CASE WHEN z < 0 THEN -1 ELSE 1 END * (1 - t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-z * z / 2))), 7) AS p
FROM (SELECT c_custkey, z, 1 / (1 + 0.3275911 * abs(z) / sqrt(2)) AS t FROM (SELECT c_custkey, CAST(c_custkey % 81 - 40 AS DOUBLE) / 10 AS z FROM customer))""")
def _(t):
    z = (F.col("c_custkey") % 81 - 40).cast("double") / 10.0
    return t.base("customer").select("c_custkey", F.round(normal_cdf(z), 7).alias("p"))
