"""Queries over readers and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from locusloom.functions import genotype as G
from locusloom.functions import numeric as N
from locusloom.functions import text as X
from locusloom.operators.merge import unique_calls, unique_imputed
from locusloom.plans.derived import CALL_ORDER, Tables
from locusloom.plans.registry import query, r6, rounded
from locusloom.plans.views import call_dosage, dosage_genotype
from locusloom.schemas import SITE_KEY
from locusloom.sources import calls as calls_source
from locusloom.sources import files, panel, pgs, vcf


# -- array calls -----------------------------------------------------------------------

def call_lines(t: Tables):
    """Calls as text lines, with comments, blanks, padding and two kinds of bad lines."""
    p = F.col("l_partkey")
    good = F.concat_ws("\t", "rsid", "chromosome", F.col("position").cast("string"), "genotype")
    rows = t.calls(t.spread("lineitem", ["l_orderkey", "l_linenumber", *CALL_ORDER]))
    text = (
        F.when(p % 83 == 0, F.lit("# comment\tx")).when(p % 79 == 0, F.lit("  "))
        .when(p % 97 == 0, F.concat_ws("\t", "rsid", "chromosome", "genotype"))
        .when(p % 89 == 0, F.concat_ws("\t", "rsid", "chromosome", F.lit("12x"), "genotype"))
        .when(p % 71 == 0, F.concat(F.lit(" "), F.regexp_replace(good, "\t", " \t "), F.lit(" "))).otherwise(good)
    )
    # Exploding keeps the text from being made again for every use of it.
    return rows.select(F.explode(F.array(text)).alias("value"))


@query("parse_call_lines", """
SELECT CASE WHEN l_partkey % 97 <> 0 THEN rsid END AS rsid, CASE WHEN l_partkey % 97 <> 0 THEN chromosome_text END AS chromosome,
  CASE WHEN l_partkey % 97 <> 0 AND l_partkey % 89 <> 0 THEN position END AS position,
  CASE WHEN l_partkey % 97 <> 0 THEN genotype END AS genotype,
  CASE WHEN l_partkey % 97 = 0 THEN 'expected 4 fields, found 3' WHEN l_partkey % 89 = 0 THEN 'invalid position 12x' END AS error
FROM g_calls WHERE l_partkey % 83 <> 0 AND l_partkey % 79 <> 0""")
def _(t):
    return calls_source.parse_call_lines(call_lines(t)).drop("value")


@query("calls_of_autosomes", """
SELECT chromosome_text AS chromosome, count(*) AS calls FROM g_calls WHERE chromosome IS NOT NULL GROUP BY 1""")
def _(t):
    kept = calls_source.keep_chromosomes(t.calls(), calls_source.AUTOSOME_NAMES)
    return kept.groupBy("chromosome").agg(F.count("*").alias("calls"))


@query("calls_last_wins", "SELECT chromosome, position, genotype AS call_genotype FROM g_calls_last")
def _(t):
    return unique_calls(t.calls(), ["chromosome", "position"], CALL_ORDER)


# -- imputed VCF -----------------------------------------------------------------------

def vcf_lines(t: Tables):
    """Imputed rows as VCF text with every kind of odd or bad field; one file per chromosome."""
    k = F.col("k")

    def hundredths(n):
        return F.concat(F.floor(n / 100).cast("bigint").cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"))

    site = Tables._site("k")
    ds = (k * 31 + F.col("l_partkey") * 7) % 201
    r2 = F.lpad((k * 613 % 1000).cast("string"), 3, "0")
    rows = t.spread("lineitem", ["l_orderkey", "l_partkey", "l_linenumber"]).filter("l_linenumber % 2 = 0").select(
        F.col("l_orderkey").alias("k"), "l_partkey")
    chrom = F.when(k % 31 == 0, F.lit("X")).when(k % 2 == 1, F.concat(F.lit("chr"), site["chromosome"].cast("string"))).otherwise(site["chromosome"].cast("string"))
    ident = F.when(k % 7 == 0, F.lit(".")).when(k % 5 == 0, F.concat(F.lit("rs"), k.cast("string"), F.lit(";alt"))).otherwise(F.concat(F.lit("rs"), k.cast("string")))
    alt = F.when(k % 37 == 0, F.lit(".")).when(k % 11 == 0, F.concat(site["alt_allele"], F.lit(",N"))).otherwise(site["alt_allele"])
    info = F.when(k % 29 == 0, F.concat(F.lit("AF=0.1;DR2=0."), r2)).otherwise(F.concat(F.lit("AF=0.1;R2=0."), r2, F.lit(";IMPUTED")))
    fmt = F.when(k % 41 == 0, F.lit("GT:GP")).when(k % 2 == 0, F.lit("GT:HDS:GP:DS")).otherwise(F.lit("GT:DS:GP"))
    value = F.when(k % 43 == 0, F.lit("2.01")).otherwise(hundredths(ds))
    cell = F.when(k % 41 == 0, F.lit("0|1:0,1,0")).when(k % 2 == 0, F.concat(F.lit("0|1:0,1:0,1,0:"), value)).otherwise(F.concat(F.lit("0|1:"), value, F.lit(":0,1,0")))
    line = F.concat_ws("\t", chrom, site["position"].cast("string"), ident, site["ref_allele"], alt, F.lit("."), F.lit("PASS"), info, fmt, F.lit("0|0:0:0:0"), cell)
    return rows.select(
        F.concat(F.lit("chr"), site["chromosome"].cast("string"), F.lit(".dose.vcf.gz")).alias("file_path"),
        F.explode(F.when(k % 500 == 0, F.array(F.lit("##fileformat=VCFv4.2"), line)).otherwise(F.array(line))).alias("value"))


VCF_SQL = f"""
SELECT 'chr' || chromosome || '.dose.vcf.gz' AS file_path, k,
  CASE WHEN k % 31 = 0 THEN NULL ELSE chromosome END AS chromosome, position, ref_allele,
  CASE WHEN k % 37 = 0 THEN NULL ELSE alt_allele END AS alt_allele,
  CASE WHEN k % 41 = 0 THEN NULL WHEN k % 43 = 0 THEN 2.01 ELSE dosage END AS dosage,
  CASE WHEN k % 7 <> 0 THEN 'rs' || k WHEN k % 31 = 0 OR k % 37 = 0 THEN NULL
    ELSE 'chr' || chromosome || ':' || position || ':' || ref_allele || ':' || alt_allele END AS rsid, imputation_quality,
  CASE WHEN k % 31 = 0 THEN 'invalid chromosome' WHEN k % 37 = 0 THEN 'missing ALT' WHEN k % 41 = 0 THEN 'no DS in FORMAT'
    WHEN k % 43 = 0 THEN 'DS out of range' END AS error
FROM (SELECT k, chromosome, 10000 + k * 37 AS position, ref_allele, alt_allele, dosage, imputation_quality FROM g_imputed)"""


@query("parse_vcf_lines", f"SELECT rsid, chromosome, position, ref_allele, alt_allele, dosage, imputation_quality, error FROM ({VCF_SQL})")
def _(t):
    return vcf.parse_vcf_lines(vcf_lines(t)).drop("value", "file_path")


@query("vcf_file_report", f"""
SELECT file_path, count(*) AS data_rows, count(error) AS error_rows,
  count(*) FILTER (WHERE error IS NULL AND imputation_quality < 0.3) AS skipped_rows FROM ({VCF_SQL}) GROUP BY 1""")
def _(t):
    return vcf.file_report(vcf.parse_vcf_lines(vcf_lines(t)), 0.3)


@query("vcf_rejected_lines", f"SELECT error, count(*) AS lines FROM ({VCF_SQL}) WHERE error IS NOT NULL GROUP BY 1")
def _(t):
    parsed = vcf.parse_vcf_lines(vcf_lines(t))
    return parsed.filter(F.col("error").isNotNull()).groupBy("error").agg(F.count("*").alias("lines"))


@query("vcf_min_quality", f"""
SELECT rsid, chromosome, position, dosage, imputation_quality FROM ({VCF_SQL})
WHERE error IS NULL AND (imputation_quality IS NULL OR imputation_quality >= 0.8)""")
def _(t):
    parsed = vcf.parse_vcf_lines(vcf_lines(t)).filter(F.col("error").isNull())
    return vcf.filter_min_quality(parsed, 0.8).select("rsid", "chromosome", "position", "dosage", "imputation_quality")


@query("vcf_quality_tags", f"""
SELECT rsid, CASE WHEN k % 29 = 0 THEN CAST(k * 613 % 1000 AS DOUBLE) / 1000 ELSE imputation_quality END AS imputation_quality
FROM ({VCF_SQL}) WHERE error IS NULL""")
def _(t):
    return vcf.parse_vcf_lines(vcf_lines(t), ("R2", "DR2")).filter(F.col("error").isNull()).select("rsid", "imputation_quality")


@query("vcf_profile", f"""
SELECT (SELECT count(*) FROM lineitem WHERE l_linenumber % 2 = 0 AND l_orderkey % 500 = 0) AS header_rows, count(*) AS data_rows, count(error) AS error_rows,
  round(avg(dosage) FILTER (WHERE error IS NULL), 6) AS mean_dosage, count(imputation_quality) FILTER (WHERE error IS NULL) AS quality_rows,
  round(avg(imputation_quality) FILTER (WHERE error IS NULL), 6) AS mean_quality, min(imputation_quality) FILTER (WHERE error IS NULL) AS min_quality,
  max(imputation_quality) FILTER (WHERE error IS NULL) AS max_quality,
  round(CAST(count(imputation_quality) FILTER (WHERE error IS NULL) AS DOUBLE) / count(*), 6) AS quality_share FROM ({VCF_SQL})""")
def _(t):
    return rounded(vcf.profile_vcf_lines(vcf_lines(t)), "mean_dosage", "mean_quality", "quality_share")


@query("imputed_last_wins", """
SELECT chromosome, position, ref_allele, alt_allele, dosage AS imputed_dosage, imputation_quality AS imputed_r2 FROM g_imputed_last""")
def _(t):
    return unique_imputed(t.imputed(), SITE_KEY, CALL_ORDER)


@query("imputed_union", """
SELECT chromosome, count(*) AS imputed_rows, round(sum(dosage), 6) AS dosage_sum
FROM (SELECT * FROM g_imputed WHERE k % 2 = 0 UNION ALL SELECT * FROM g_imputed WHERE k % 2 = 1) GROUP BY 1""")
def _(t):
    rows = t.imputed()
    even = (F.col("position") - F.when(F.col("position") % 37 == 12, 2).otherwise(0) - 10000) % 74 == 0
    both = rows.filter(even).unionByName(rows.filter(~even))
    return both.groupBy("chromosome").agg(F.count("*").alias("imputed_rows"), r6(F.sum("dosage")).alias("dosage_sum"))


# -- panel -----------------------------------------------------------------------------

@query("panel_from_json", """
SELECT chromosome, position, rsid, ref_allele, alt_allele, imputation_quality, is_typed, cells FROM g_panel
JOIN (SELECT k, string_agg(genotype, ',' ORDER BY i) AS cells FROM g_panel_samples GROUP BY k) s USING (k)""")
def _(t):
    rows = panel.panel_from_stored(panel.panel_to_stored(t.panel()))
    return rows.select("chromosome", "position", "rsid", "ref_allele", "alt_allele", "imputation_quality", "is_typed",
                       F.array_join("sample_genotypes", ",").alias("cells"))


@query("panel_one_chromosome", "SELECT chromosome, position, rsid, ref_allele, alt_allele FROM g_panel WHERE chromosome = 7")
def _(t):
    return panel.chromosome_variants(t.panel(), 7).select("chromosome", "position", "rsid", "ref_allele", "alt_allele")


@query("panel_metadata", "SELECT n_name AS key, CAST(n_regionkey AS VARCHAR) AS value FROM nation WHERE n_name = 'NATION_7'")
def _(t):
    rows = t.base("nation").select(F.col("n_name").alias("key"), F.col("n_regionkey").cast("string").alias("value"))
    return panel.panel_metadata(rows, "NATION_7")


@query("panel_counts", "SELECT chromosome, count(*) AS variants FROM g_panel GROUP BY 1")
def _(t):
    return panel.panel_counts(t.panel())


@query("panel_total", "SELECT count(*) AS variants FROM g_panel")
def _(t):
    return panel.panel_total(t.panel())


@query("panel_validation", """
SELECT 'variants' AS table_name, count(*) AS row_count FROM g_panel UNION ALL SELECT 'metadata', count(*) FROM nation""")
def _(t):
    rows = t.base("nation").select(F.col("n_name").alias("key"), F.col("n_regionkey").cast("string").alias("value"))
    return panel.validate_panel(t.panel(), rows)


@query("panel_build", """
SELECT chromosome, count(*) AS variants, count(*) FILTER (WHERE is_typed) AS typed, count(*) FILTER (WHERE first_cell = '1|1') AS first_hom
FROM g_panel JOIN (SELECT k, genotype AS first_cell FROM g_panel_samples WHERE i = 1) s USING (k) GROUP BY 1""")
def _(t):
    sites = t.panel()
    wide = sites.select(
        "chromosome", F.col("position").alias("bp37"), "rsid", F.col("ref_allele").alias("REF"), F.col("alt_allele").alias("ALT"),
        F.col("phased").alias("PHASED"), F.col("allele_freq").alias("AF"), F.col("minor_allele_freq").alias("MAF"),
        F.col("imputation_quality").alias("R2"), F.col("is_typed").alias("TYPED"),
        *[F.col("sample_genotypes")[i].alias(f"samp{i + 1}") for i in range(50)])
    built = panel.nest_wide(wide)
    return built.groupBy("chromosome").agg(
        F.count("*").alias("variants"), F.count_if("is_typed").alias("typed"),
        F.count_if(F.col("sample_genotypes")[0] == "1|1").alias("first_hom"))


# -- score files -----------------------------------------------------------------------

@query("read_scores_long", """
SELECT sample_id, label, CASE WHEN CAST(sample_id AS BIGINT) % 53 = 0 THEN NULL ELSE value END AS value,
  CASE WHEN CAST(sample_id AS BIGINT) % 53 = 0 THEN 'invalid value inf' END AS error FROM g_pgs""")
def _(t):
    text = F.when(F.col("sample_id").cast("bigint") % 53 == 0, F.lit("inf")).otherwise(F.col("value").cast("string"))
    return pgs.long_scores(t.pgs().select(F.col("sample_id").alias("ID"), F.col("label").alias("PGS_label"), text.alias("score_value")))


@query("read_scores_wide", """
SELECT sample_id, l.label, value + l.plus AS value FROM g_pgs, (VALUES ('height', 0.0), ('bmi', 1.0), ('t2d', 2.0)) l(label, plus)""")
def _(t):
    quoted = F.concat(F.lit('"'), F.col("sample_id"), F.lit('"'))
    wide = t.pgs().select(quoted.alias("sample"), F.col("value").cast("string").alias("height"),
                          (F.col("value") + 1.0).cast("string").alias('"bmi"'), (F.col("value") + 2.0).cast("string").alias("t2d"))
    return pgs.wide_scores(wide).drop("error")


# -- file names ------------------------------------------------------------------------

@query("classify_files", """
SELECT CASE WHEN file_name LIKE '%.txt' AND file_name NOT LIKE '%scores%' THEN 'genome'
  WHEN file_name LIKE '%.vcf.gz' OR file_name LIKE '%.vcf' THEN 'vcf' WHEN file_name LIKE '%scores%.txt' THEN 'pgs' ELSE 'other' END AS kind,
  CASE WHEN file_name LIKE 'genome\\_%.txt' ESCAPE '\\' THEN 'genome' WHEN file_name LIKE 'chr%.dose.vcf.gz' THEN 'vcf'
  WHEN file_name = 'scores.txt' THEN 'pgs' ELSE 'other' END AS strict_kind, count(*) AS files FROM g_files GROUP BY 1, 2""")
def _(t):
    rows = t.files()
    return rows.select(
        files.classify_name(F.col("file_name")).alias("kind"), files.classify_name_strict(F.col("file_name")).alias("strict_kind"),
    ).groupBy("kind", "strict_kind").agg(F.count("*").alias("files"))


@query("missing_inputs", """
SELECT 'missing chr' || range || '.dose.vcf.gz' AS problem FROM range(1, 23)
WHERE 'chr' || range || '.dose.vcf.gz' NOT IN (SELECT file_name FROM g_files WHERE length % 7 = 0)
UNION ALL SELECT 'missing ' || x FROM (VALUES ('genome'), ('pgs')) v(x)
WHERE (x = 'genome' AND NOT EXISTS (SELECT 1 FROM g_files WHERE length % 7 = 0 AND file_name LIKE 'genome%'))
   OR (x = 'pgs' AND NOT EXISTS (SELECT 1 FROM g_files WHERE length % 7 = 0 AND file_name = 'scores.txt'))
UNION ALL SELECT 'expected 22 VCF files, found ' || count(*) FROM g_files
WHERE length % 7 = 0 AND file_name LIKE 'chr%.dose.vcf.gz' HAVING count(*) <> 22""")
def _(t):
    return files.missing_inputs(t.files().filter("length % 7 = 0"))


@query("missing_inputs_all_files", """
WITH f AS (SELECT CASE file_name WHEN 'chr7.dose.vcf.gz' THEN 'chr7.dose.vcf.gz.part' WHEN 'scores.txt' THEN 'scores.txt.part' ELSE file_name END AS file_name FROM g_files)
SELECT 'missing chr' || range || '.dose.vcf.gz' AS problem FROM range(1, 23)
WHERE 'chr' || range || '.dose.vcf.gz' NOT IN (SELECT file_name FROM f)
UNION ALL SELECT 'missing ' || x FROM (VALUES ('genome'), ('pgs')) v(x)
WHERE (x = 'genome' AND NOT EXISTS (SELECT 1 FROM f WHERE file_name LIKE 'genome%'))
   OR (x = 'pgs' AND NOT EXISTS (SELECT 1 FROM f WHERE file_name = 'scores.txt'))
UNION ALL SELECT 'expected 22 VCF files, found ' || count(*) FROM f
WHERE file_name LIKE 'chr%.dose.vcf.gz' HAVING count(*) <> 22""")
def _(t):
    # Every file is looked at; two names are changed, as of files half copied, so that something is missing.
    name = F.col("file_name")
    half = F.when(name.isin("chr7.dose.vcf.gz", "scores.txt"), F.concat(name, F.lit(".part"))).otherwise(name)
    return files.missing_inputs(t.files().withColumn("file_name", half))


@query("ingest_checks", """
WITH n AS (SELECT *, left(regexp_replace(regexp_replace(file_name, '[/\\\\]', '_', 'g'), '[^A-Za-z0-9_.-]', '', 'g'), 255) AS safe_name,
  CASE WHEN file_name LIKE 'genome%' OR file_name LIKE '.hidden%' THEN 'genome' WHEN file_name LIKE '%.vcf.gz' THEN 'vcf'
    WHEN file_name = 'scores.txt' THEN 'pgs' ELSE 'other' END AS kind FROM g_files),
m AS (SELECT *, CASE WHEN safe_name LIKE '%.vcf.gz' THEN 'vcf.gz' WHEN safe_name LIKE '%.vcf.gz.tbi' THEN 'vcf.gz.tbi'
    WHEN safe_name LIKE '%.pgs' OR safe_name LIKE '%.txt.gz' THEN 'pgs' ELSE lower(regexp_extract(safe_name, '[^.]*$')) END AS extension,
  CASE kind WHEN 'genome' THEN 104857600 WHEN 'vcf' THEN 209715200 WHEN 'pgs' THEN 10485760 ELSE 524288000 END AS cap FROM n)
SELECT file_name, safe_name, extension, length, CASE WHEN length > cap THEN 'file too large' WHEN safe_name LIKE '.%' THEN 'hidden file name'
  WHEN extension NOT IN ('txt', 'vcf.gz', 'vcf.gz.tbi', 'pgs') THEN 'invalid file type' END AS reason FROM m""")
def _(t):
    rows = t.files().select("file_name", "length")
    return files.manifest_checks(files.classify_files(rows)).select("file_name", "safe_name", "extension", "length", "reason")


# -- scalar functions ------------------------------------------------------------------

def _with_sites(t: Tables):
    """Calls beside the alleles of their own place, plus odd texts."""
    k, odd = F.col("l_orderkey"), F.col("l_partkey") % 10
    site = Tables._site("l_orderkey")
    ref, alt = site["ref_allele"], site["alt_allele"]
    kind = (k + F.col("l_suppkey")) % 6
    pair = F.when(kind == 0, F.concat(ref, ref)).when(kind == 1, F.concat(ref, alt)).when(kind == 2, F.concat(alt, ref)).when(kind == 3, F.concat(alt, alt)).when(kind == 4, F.lit("--")).otherwise(F.lit("DI"))
    g = F.when(odd == 0, F.translate(pair, "ACGT", "TGCA")).when(odd == 1, F.substring(pair, 1, 1)).when(odd == 2, F.concat(pair, F.lit("A"))).when(odd == 3, F.lit("")).otherwise(pair)
    return t.base("lineitem").select(k.alias("k"), "l_linenumber", "l_partkey", g.alias("genotype"), ref.alias("ref_allele"),
                                     F.when(k % 15 == 0, F.concat(alt, F.lit("A"))).otherwise(alt).alias("alt_allele"))


_ODD_SQL = """
SELECT k, l_linenumber, l_partkey, ref_allele, CASE WHEN k % 15 = 0 THEN alt || 'A' ELSE alt END AS alt_allele,
  CASE l_partkey % 10 WHEN 0 THEN translate(pair, 'ACGT', 'TGCA') WHEN 1 THEN substr(pair, 1, 1) WHEN 2 THEN pair || 'A' WHEN 3 THEN '' ELSE pair END AS genotype
FROM (SELECT l_orderkey AS k, l_linenumber, l_partkey, s.ref_allele, s.alt_allele AS alt,
  CASE (l_orderkey + l_suppkey) % 6 WHEN 0 THEN s.ref_allele || s.ref_allele WHEN 1 THEN s.ref_allele || s.alt_allele
    WHEN 2 THEN s.alt_allele || s.ref_allele WHEN 3 THEN s.alt_allele || s.alt_allele WHEN 4 THEN '--' ELSE 'DI' END AS pair
  FROM lineitem JOIN g_sites s ON s.k = l_orderkey)"""


@query("call_to_dosage", f"""
SELECT genotype, ref_allele, alt_allele, dosage, CASE WHEN genotype IN ('', '--') THEN 'missing' WHEN length(genotype) <> 2 THEN 'invalid_format'
  WHEN dosage IS NULL THEN 'alleles_mismatch' ELSE 'ok' END AS status, count(*) AS calls
FROM (SELECT *, {call_dosage('genotype')} AS dosage FROM ({_ODD_SQL})) GROUP BY ALL""")
def _(t):
    rows = _with_sites(t).withColumn("r", G.genotype_to_dosage("genotype", "ref_allele", "alt_allele"))
    return rows.groupBy("genotype", "ref_allele", "alt_allele", F.col("r.dosage").alias("dosage"), F.col("r.status").alias("status")).agg(F.count("*").alias("calls"))


@query("call_to_dosage_with_flip", f"""
SELECT genotype, flipped, ref_allele, alt_allele, coalesce({call_dosage('genotype')}, {call_dosage('flipped')}) AS dosage, count(*) AS calls
FROM (SELECT *, translate(genotype, 'ACGT', 'TGCA') AS flipped FROM ({_ODD_SQL})) GROUP BY ALL""")
def _(t):
    rows = _with_sites(t).select("genotype", G.flip_strand("genotype").alias("flipped"), "ref_allele", "alt_allele",
                                 G.call_dosage_with_flip("genotype", "ref_allele", "alt_allele").alias("dosage"))
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("calls"))


@query("snp_test", f"""
SELECT length(ref_allele) = 1 AND length(alt_allele) = 1 AS is_snp, genotype ~ '^[ACGT]{{2}}$' AS clean,
  CASE WHEN genotype ~ '^[ACGT]{{2}}$' THEN substr(genotype, 1, 1) <> substr(genotype, 2, 1) END AS heterozygous, count(*) AS calls
FROM ({_ODD_SQL}) GROUP BY ALL""")
def _(t):
    rows = _with_sites(t).select(G.is_snp("ref_allele", "alt_allele").alias("is_snp"), F.col("genotype").rlike("^[ACGT]{2}$").alias("clean"),
                                 G.is_heterozygous("genotype").alias("heterozygous"))
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("calls"))


@query("call_display", f"""
SELECT genotype, ref_allele, alt_allele, CASE {call_dosage('genotype')} WHEN 0 THEN '0/0' WHEN 1 THEN '0/1' WHEN 2 THEN '1/1' ELSE './.' END AS display,
  count(*) AS calls FROM ({_ODD_SQL}) GROUP BY ALL""")
def _(t):
    rows = _with_sites(t).select("genotype", "ref_allele", "alt_allele", G.display_call("genotype", "ref_allele", "alt_allele").alias("display"))
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("calls"))


@query("dosage_to_genotype", f"""
SELECT dosage, {dosage_genotype('dosage')} AS nearest, {dosage_genotype('dosage', 0.25, 1.25)} AS half_step,
  CASE WHEN imputation_quality < 0.3 THEN 'ImputedLowQual' ELSE 'Imputed' END AS source, count(*) AS imputed_rows FROM g_imputed GROUP BY ALL""")
def _(t):
    rows = t.imputed().select("dosage", G.dosage_genotype("dosage").alias("nearest"), G.dosage_genotype("dosage", "half_step").alias("half_step"),
                              G.imputed_source("imputation_quality").alias("source"))
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("imputed_rows"))


@query("genotype_text_dosage", """
SELECT genotype, dosage, count(*) AS cells, dosage > 2 AND genotype NOT LIKE '0%' AS many FROM (
  SELECT a || sep || b AS genotype, CASE WHEN sep = '' THEN 0.0 ELSE CAST((CASE WHEN a = '.' THEN 0 ELSE CAST(a AS INTEGER) END) + CAST(b AS INTEGER) AS DOUBLE) END AS dosage
  FROM (SELECT CASE WHEN l_partkey % 9 = 0 THEN '.' ELSE CAST(l_partkey % 4 AS VARCHAR) END AS a, CAST(l_suppkey % 3 AS VARCHAR) AS b,
    CASE l_linenumber % 4 WHEN 0 THEN '/' WHEN 1 THEN '' ELSE '|' END AS sep FROM lineitem)) GROUP BY ALL""")
def _(t):
    n = F.col("l_linenumber") % 4
    a = F.when(F.col("l_partkey") % 9 == 0, F.lit(".")).otherwise((F.col("l_partkey") % 4).cast("string"))
    g = F.concat(a, F.when(n == 0, F.lit("/")).when(n == 1, F.lit("")).otherwise(F.lit("|")), (F.col("l_suppkey") % 3).cast("string"))
    rows = t.base("lineitem").select(g.alias("genotype")).select(
        "genotype", G.genotype_text_dosage("genotype").alias("dosage"))
    return rows.groupBy("genotype", "dosage").agg(F.count("*").alias("cells")).withColumn(
        "many", (F.col("dosage") > 2) & ~F.col("genotype").startswith("0"))


@query("number_parsing", """
SELECT l_linenumber, count(*) AS lines, count(*) FILTER (WHERE l_linenumber IN (1, 2, 3)) AS parsed,
  round(sum(CASE l_linenumber WHEN 1 THEN l_extendedprice WHEN 2 THEN -l_extendedprice WHEN 3 THEN l_quantity * 10 END), 4) AS total
FROM lineitem GROUP BY 1""")
def _(t):
    n, price = F.col("l_linenumber"), F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    text = (F.when(n == 1, price).when(n == 2, F.concat(F.lit("-"), price)).when(n == 3, F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("e1")))
            .when(n == 4, F.concat(F.lit(" "), price)).when(n == 5, F.concat(price, F.lit("d"))).when(n == 6, F.lit("NaN")).otherwise(F.lit("inf")))
    value = N.parse_double(text)
    return t.base("lineitem").groupBy("l_linenumber").agg(
        F.count("*").alias("lines"), F.count_if(N.is_finite(value)).alias("parsed"), F.round(F.sum(value), 4).alias("total"))


@query("fixed_decimals", """
SELECT k, printf('%.3f', r2) AS text3, printf('%.4f', r2) AS text4, printf('%.3f', sixteenth) AS tie3
FROM (SELECT o_orderkey AS k, CAST(o_orderkey * 613 % 20000 AS DOUBLE) / 10000 AS r2, CAST(o_orderkey % 64 AS DOUBLE) / 16 AS sixteenth FROM orders)""")
def _(t):
    k = F.col("o_orderkey")
    r2, tie = (k * 613 % 20000).cast("double") / 10000.0, (k % 64).cast("double") / 16.0
    rows = t.base("orders").select(k.alias("k"), r2.alias("r2"), tie.alias("tie"))
    return rows.select("k", N.fixed_decimals("r2", 3).alias("text3"), N.fixed_decimals("r2", 4).alias("text4"), N.fixed_decimals("tie", 3).alias("tie3"))


@query("chromosome_names", """
SELECT o_orderkey % 30 AS n, CASE WHEN o_orderkey % 30 BETWEEN 1 AND 22 THEN CAST(o_orderkey % 30 AS INTEGER) END AS from_chr,
  CASE WHEN o_orderkey % 30 BETWEEN 1 AND 22 THEN CAST(o_orderkey % 30 AS INTEGER) END AS plain, count(*) AS orders FROM orders GROUP BY ALL""")
def _(t):
    n = (F.col("o_orderkey") % 30)
    rows = t.base("orders").select(n.alias("n"), G.vcf_chromosome(F.concat(F.lit("chr"), n.cast("string"))).alias("from_chr"), G.autosome_number(n.cast("string")).alias("plain"))
    return rows.groupBy("n", "from_chr", "plain").agg(F.count("*").alias("orders"))


@query("sample_map_json", """
SELECT k, CAST(json_extract_string(doc, '$.samp1') AS VARCHAR) AS first_cell, CAST(json_extract_string(doc, '$.samp50') AS VARCHAR) AS last_cell
FROM (SELECT k, json_group_object('samp' || i, genotype) AS doc FROM g_panel_samples GROUP BY k)""")
def _(t):
    doc = X.array_to_sample_map("sample_genotypes")
    rows = t.panel().select(((F.col("position") - 10000) / 37).cast("bigint").alias("k"), doc.alias("doc"))
    return rows.select("k", F.get_json_object("doc", "$.samp1").alias("first_cell"), F.get_json_object("doc", "$.samp50").alias("last_cell"))


@query("threshold_names", """
SELECT c_mktsegment AS segment, n, CASE n WHEN 0 THEN NULL WHEN 1 THEN 0.8 WHEN 2 THEN 0.8 ELSE 0.9 END::DOUBLE AS threshold,
  CASE n WHEN 0 THEN 'parquet,vcf' WHEN 1 THEN 'parquet,vcf' WHEN 2 THEN 'json' ELSE 'tables' END AS formats, count(*) AS customers
FROM (SELECT c_mktsegment, c_custkey % 5 AS n FROM customer) GROUP BY ALL""")
def _(t):
    n = F.col("c_custkey") % 5
    text = F.when(n == 0, " None").when(n == 1, "r080").when(n == 2, "0.8").when(n == 3, "R090").otherwise("strange")
    formats = F.when(n == 0, "").when(n == 1, "VCF, parquet,vcf").when(n == 2, "json,json").otherwise("tables, x")
    rows = t.base("customer").select(F.col("c_mktsegment").alias("segment"), n.alias("n"), X.parse_threshold_column(text).alias("threshold"),
                                     F.array_join(X.parse_formats_column(formats), ",").alias("formats"))
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("customers"))


@query("normal_curve", """
SELECT label, i, round(-4 + i * 0.1, 6) AS z, round(exp(-power(-4 + i * 0.1, 2) / 2) / sqrt(2 * pi()), 5) AS density, n AS scores
FROM (SELECT label, count(*) AS n FROM g_pgs GROUP BY 1), (SELECT CAST(range AS INTEGER) AS i FROM range(0, 81))""")
def _(t):
    counts = t.pgs().groupBy("label").agg(F.count("*").alias("scores"))
    rows = counts.select("label", "scores", F.posexplode(N.density_series()).alias("i", "p"))
    return rows.select("label", "i", F.round("p.z", 6).alias("z"), F.round("p.density", 5).alias("density"), "scores")
