"""Queries that write files into the shared folder and read them back."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusloom.functions.genotype import flip_strand, passes_quality
from locusloom.operators import compare
from locusloom.operators.merge import WORKER_RULES, merge_counters, merge_single_sample, unique_calls
from locusloom.operators.stats import match_metrics, run_statistics
from locusloom.plans.catalog_sources import VCF_SQL, call_lines, vcf_lines
from locusloom.plans.derived import CALL_ORDER
from locusloom.plans.registry import ORACLE, merged, query, r6
from locusloom.plans.views import call_dosage
from locusloom.schemas import SITE_KEY
from locusloom.session import stage, staged_path
from locusloom.sinks import blocks as block_sink
from locusloom.sinks import tables, vcf
from locusloom.sinks.zones import ZoneTable
from locusloom.sources import pgs
from locusloom.sources.blocks import read_block_lines
from locusloom.sources.files import output_register
from locusloom.sources.vcf import read_vcf

#: Tests' tables are small; ranges of this size still give a file to several tasks.
_RANGE = 1 << 16
_PARSED = "rsid, chromosome, position, ref_allele, alt_allele, dosage, imputation_quality"


@query("vcf_from_blocks", f"SELECT {_PARSED} FROM ({VCF_SQL}) WHERE error IS NULL")
def _(t):
    path = staged_path(t.spark, "imputed-blocks")
    block_sink.write_block_text(vcf_lines(t).select("value"), path)
    read = read_vcf(t.spark, f"{path}/data", max_errors=2**62, lines=partial(read_block_lines, range_bytes=_RANGE))
    return read.rows.select(*_PARSED.split(", "))


@query("vcf_reports_of_chromosome_files", f"""
SELECT regexp_extract(file_path, 'chr([0-9]+)', 1) AS file, count(*) AS data_rows, count(error) AS error_rows,
  count(*) FILTER (WHERE error IS NULL AND imputation_quality < 0.3) AS skipped_rows, round(sum(dosage) FILTER (WHERE error IS NULL AND
  (imputation_quality IS NULL OR imputation_quality >= 0.3)), 6) AS dosage_sum FROM ({VCF_SQL}) GROUP BY 1""")
def _(t):
    path = staged_path(t.spark, "imputed-files")
    name = F.regexp_extract("file_path", "chr([0-9]+)", 1).alias("file")
    lines = vcf_lines(t).select(name, "value")
    lines.write.partitionBy("file").option("compression", "gzip").text(path)  # plain gzip, one folder per chromosome
    read = read_vcf(t.spark, path, 0.3, max_errors=2**62)
    file = F.regexp_extract("file_path", "file=([0-9]+)", 1).alias("file")
    sums = read.rows.groupBy(file).agg(r6(F.sum("dosage")).alias("dosage_sum"))
    counts = read.report.groupBy(file).agg(*[F.sum(c).alias(c) for c in ("data_rows", "error_rows", "skipped_rows")])
    return counts.join(sums, "file")


def _block_vcf(t) -> str:
    path = staged_path(t.spark, "vcf-blocks")
    vcf.write_block_vcf(merged(t), path, vcf.multi_sample_header("20250101"))
    return path


@query("vcf_block_lines")
def _(t):
    lines = read_block_lines(t.spark, f"{_block_vcf(t)}/data", _RANGE)
    return lines.filter(~F.col("value").startswith("#")).select("value")


@query("vcf_region_by_index")
def _(t):
    return block_sink.region_lines(t.spark, _block_vcf(t), 3, 20_000, 200_000).select("value")


ORACLE["vcf_block_lines"] = f"SELECT value FROM ({ORACLE['vcf_lines']})"
ORACLE["vcf_region_by_index"] = f"SELECT value FROM ({ORACLE['vcf_lines']}) WHERE chromosome = 3 AND position BETWEEN 20000 AND 200000"


@query("vcf_chromosome_folders", f"""
SELECT c.chromosome, {len(vcf.multi_sample_header('20250101'))} AS header_lines, count(m.position) AS body_lines,
  CAST(coalesce(sum(m.position), 0) AS BIGINT) AS position_sum
FROM (SELECT CAST(range AS INTEGER) AS chromosome FROM range(1, 23)) c LEFT JOIN g_merged m USING (chromosome) GROUP BY 1""")
def _(t):
    path = staged_path(t.spark, "vcf-chromosomes")
    vcf.write_vcf_per_chromosome(merged(t), path, vcf.multi_sample_header("20250101"))
    head = F.col("value").startswith("#")
    position = F.when(~head, F.get(F.split("value", "\t", 3), F.lit(1)).cast("bigint"))
    return t.spark.read.text(path).groupBy(F.col("chromosome").cast("int").alias("chromosome")).agg(
        F.count_if(head).cast("int").alias("header_lines"), F.count_if(~head).alias("body_lines"),
        F.coalesce(F.sum(position), F.lit(0)).alias("position_sum"))


def _long_sums(long: DataFrame) -> DataFrame:
    return long.groupBy("chromosome", "sample_id").agg(F.count("*").alias("variants"), r6(F.sum("dosage")).alias("dosage_sum"))


@query("long_parquet_slice", """
SELECT chromosome, sample_id, count(*) AS variants, round(sum(dosage), 6) AS dosage_sum FROM g_long WHERE chromosome IN (2, 3, 5) GROUP BY 1, 2""")
def _(t):
    path = staged_path(t.spark, "long")
    tables.write_long_parquet(merged(t), path)
    return _long_sums(tables.read_long_parquet(t.spark, path, [2, 3, 5], ["chromosome", "sample_id", "dosage"]))


@query("long_parquet_one_folder", """
SELECT chromosome, sample_id, count(*) AS variants, round(sum(dosage), 6) AS dosage_sum FROM g_long GROUP BY 1, 2""")
def _(t):
    path = staged_path(t.spark, "long-flat")
    tables.write_long_parquet(merged(t), path, partitioned=False)
    return _long_sums(tables.read_long_parquet(t.spark, path))


@query("single_parquet_rows", "SELECT chromosome, position, ref_allele, alt_allele, rsid, dosage, source, imputation_quality FROM g_single")
def _(t):
    path = staged_path(t.spark, "single")
    tables.write_single_parquet(merge_single_sample(t.imputed(), t.calls(), 0.9, CALL_ORDER), path)
    rows = t.spark.read.parquet(path)
    return rows.withColumn("chromosome", F.col("chromosome").cast("int")).select(
        "chromosome", "position", "ref_allele", "alt_allele", "rsid", "dosage", "source", "imputation_quality")


@query("json_documents", """
SELECT chromosome, count(*) // 51 AS variants, round(sum(dosage), 6) AS dosage_sum, min(CAST((SELECT count(*) FROM g_merged) AS VARCHAR)) AS total_snps
FROM g_long GROUP BY 1""")
def _(t):
    path, rows = staged_path(t.spark, "json"), stage(merged(t), "merged")
    tables.write_json(rows, tables.run_metadata(run_statistics(rows), "job-1", "user-1", "2025-01-01T00:00:00Z"), path, staged=True)
    total = F.lit(str(t.spark.read.json(f"{path}/metadata").first()["total_snps"]))  # one document
    parsed = t.spark.read.text(f"{path}/variants").select(F.from_json("value", "chromosome int, samples array<struct<dosage: double>>").alias("d"))
    dosage = F.aggregate("d.samples.dosage", F.lit(0.0), lambda a, x: a + x)
    sums = parsed.select("d.chromosome", dosage.alias("dosage")).groupBy("chromosome")
    return sums.agg(F.count("*").alias("variants"), r6(F.sum("dosage")).alias("dosage_sum")).withColumn("total_snps", total)


@query("score_files", """
SELECT CAST(c_custkey AS VARCHAR) AS sample_id, c_mktsegment AS label, c_acctbal AS value FROM customer
UNION ALL SELECT 's' || c_custkey, 'balance', c_acctbal FROM customer UNION ALL SELECT 's' || c_custkey, 'nation', c_nationkey FROM customer""")
def _(t):
    path, rows = staged_path(t.spark, "scores"), t.base("customer")
    rows.selectExpr("c_custkey AS ID", "c_mktsegment AS PGS_label", "c_acctbal AS score_value").write.csv(f"{path}/long", header=True)
    rows.selectExpr("concat('s', c_custkey) AS sample", "c_acctbal AS balance", "c_nationkey AS nation").write.csv(f"{path}/wide", header=True)
    return pgs.read_pgs_scores(t.spark, f"{path}/long").unionByName(pgs.read_pgs_scores(t.spark, f"{path}/wide"))


def _customer_files(t) -> str:
    """Customers as text, a thousand to a file."""
    path = staged_path(t.spark, "hashed")
    rows = t.base("customer").selectExpr("c_custkey div 1000 AS file", "c_custkey", "concat_ws('\t', c_custkey, c_name) AS value")
    parts = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartition(parts, "file").sortWithinPartitions("file", "c_custkey").select("file", "value").write.partitionBy("file").text(path)
    return path


@query("written_file_hashes", """
SELECT c_custkey // 1000 AS file, count(*) AS lines, CAST(sum(strlen(line)) AS BIGINT) AS length, sha256(string_agg(line, '' ORDER BY c_custkey)) AS hash_sha256
FROM (SELECT c_custkey, c_custkey || chr(9) || c_name || chr(10) AS line FROM customer) GROUP BY 1""")
def _(t):
    path = _customer_files(t)
    file = F.regexp_extract("path", "file=([0-9]+)", 1).cast("bigint").alias("file")
    lines = t.spark.read.text(path).groupBy(F.col("file").cast("bigint").alias("file")).agg(F.count("*").alias("lines"))
    return output_register(t.spark, path).select(file, "length", "hash_sha256").join(lines, "file").select("file", "lines", "length", "hash_sha256")


_RUN = "chromosome, position, ref_allele, alt_allele, user_genotype, user_dosage, user_source"


@query("variants_of_two_runs", f"""
SELECT {_RUN} FROM g_merged_worker WHERE ref_allele IN ('A', 'C') UNION ALL SELECT {_RUN} FROM g_merged WHERE ref_allele NOT IN ('A', 'C')""")
def _(t):
    path = staged_path(t.spark, "relational")
    first, second = merged(t), merged(t, WORKER_RULES).filter(F.col("ref_allele").isin("A", "C"))
    tables.upsert_variants(first, path)
    tables.upsert_variants(second, path)  # a second run over half of the keys, in every bin
    return tables.variant_table(t.spark, path, first.schema).read().select(*_RUN.split(", "))


_CHANGED = "translate(c.genotype, 'ACGT', 'TGCA')"


@query("input_rules", f"""
WITH calls AS (SELECT *, l_partkey % 97 = 0 AS short FROM g_calls WHERE l_partkey % 83 <> 0 AND l_partkey % 79 <> 0)
SELECT 'vcf_version' AS rule, count(DISTINCT chromosome) - count(DISTINCT chromosome) FILTER (WHERE k % 500 = 0) AS violations FROM g_imputed
UNION ALL SELECT 'vcf_chromosome', count(*) FILTER (WHERE k % 31 = 0) FROM g_imputed
UNION ALL SELECT 'vcf_info', count(*) FILTER (WHERE k % 29 = 0) FROM g_imputed
UNION ALL SELECT 'vcf_alleles', count(*) FILTER (WHERE k % 37 = 0) FROM g_imputed
UNION ALL SELECT 'call_header', CASE WHEN count(*) FILTER (WHERE l_partkey % 83 = 0) < 1000 THEN 1 ELSE 0 END FROM g_calls
UNION ALL SELECT 'call_chromosome', count(*) FROM calls WHERE chromosome_text = 'X' AND (short OR l_partkey % 89 = 0 OR l_partkey % 71 <> 0)
UNION ALL SELECT 'call_genotype', count(*) FROM calls WHERE short
UNION ALL SELECT 'weight_columns', 1 UNION ALL SELECT 'weight_duplicate_ids', count(*) - count(DISTINCT k // 2) FROM g_weights
UNION ALL SELECT 'weight_number', count(*) FILTER (WHERE k % 17 = 0) FROM g_weights
UNION ALL SELECT 'panel_dosage', count(*) FROM g_panel_samples WHERE genotype = '1|1'
UNION ALL SELECT 'call_strand', count(*) FROM g_panel p JOIN g_calls_last c ON c.chromosome = p.chromosome AND c.position = p.position
  WHERE {call_dosage('c.genotype', 'p.ref_allele', 'p.alt_allele')} IS NOT NULL AND {call_dosage(_CHANGED, 'p.ref_allele', 'p.alt_allele')} IS NULL""")
def _(t):
    """Inputs with violations of every kind: names, versions, alleles, another strand, a third allele, texts for numbers."""
    heads = call_lines(t).select(F.replace("value", F.lit("\tX\t"), F.lit("\tXY\t")).alias("value"), F.lit("genome.txt").alias("file_path"))
    k = F.substring("rsid", 3, 20).cast("bigint")
    weights = t.weights().select(
        F.concat(F.lit("rs"), F.floor(k / 2).cast("string")).alias("SNP"), F.col("chromosome").alias("CHR"), F.col("position").alias("BP"),
        F.col("effect_allele").alias("A1"), F.when(k % 17 == 0, F.lit("n/a")).otherwise(F.col("weight").cast("string")).alias("weight"))
    panel = t.panel().withColumn("sample_genotypes", F.transform("sample_genotypes", lambda g: F.replace(g, F.lit("1|1"), F.lit("1|2"))))
    calls = unique_calls(t.calls(), ["chromosome", "position"], CALL_ORDER).withColumn("call_genotype", flip_strand("call_genotype"))
    return compare.input_rules(vcf_lines(t), heads, weights, panel, calls, ("R2",), 1000)


@query("run_summary_document", """
WITH usable AS (SELECT chromosome, position FROM g_calls_last WHERE regexp_full_match(genotype, '[ACGT][ACGT]')),
measured AS (SELECT DISTINCT chromosome, position FROM g_merged WHERE user_source = 'Genotyped'),
rates AS (SELECT u.chromosome, round(100.0 * count(m.position) / count(*), 3) AS rate FROM usable u LEFT JOIN measured m USING (chromosome, position) GROUP BY 1)
SELECT 'job-1/user-1/2025-01-01T00:00:00Z' AS run, 'chr' || chromosome AS name, count(*) AS total, count(*) FILTER (WHERE user_source = 'Genotyped') AS genotyped,
  count(*) FILTER (WHERE user_source <> 'Genotyped') AS imputed, any_value(rate) AS rate, NULL AS sha256 FROM g_merged LEFT JOIN rates USING (chromosome) GROUP BY chromosome
UNION ALL SELECT 'job-1/user-1/2025-01-01T00:00:00Z', 'file' || (c_custkey // 1000), CAST(sum(strlen(line)) AS BIGINT), NULL, NULL, NULL, sha256(string_agg(line, '' ORDER BY c_custkey))
FROM (SELECT c_custkey, c_custkey || chr(9) || c_name || chr(10) AS line FROM customer) GROUP BY c_custkey // 1000""")
def _(t):
    rows, number = merged(t), F.regexp_extract("path", "file=([0-9]+)", 1)
    register = output_register(t.spark, _customer_files(t)).withColumn("file_name", F.concat(F.lit("file"), number))
    metrics = match_metrics(rows, unique_calls(t.calls(), ["chromosome", "position"], CALL_ORDER))
    document = tables.summary_document(merge_counters(t.panel(), rows), metrics, register, "job-1", "user-1", "2025-01-01T00:00:00Z")
    schema = ("job_id string, user_id string, created_at string, files array<struct<name: string, size: bigint, sha256: string>>, chromosomes "
              "array<struct<chr: int, snps_total: bigint, snps_genotyped: bigint, snps_imputed: bigint, match_rate: double>>")
    read = document.select(F.from_json("summary", schema).alias("d")).select("d.*").withColumn("run", F.concat_ws("/", "job_id", "user_id", "created_at"))
    counts = read.select("run", F.explode("chromosomes").alias("c")).selectExpr(
        "run", "concat('chr', c.chr) AS name", "c.snps_total AS total", "c.snps_genotyped AS genotyped", "c.snps_imputed AS imputed", "c.match_rate AS rate",
        "CAST(NULL AS string) AS sha256")
    files = read.select("run", F.explode("files").alias("f")).selectExpr(
        "run", "f.name AS name", "f.size AS total", "CAST(NULL AS bigint) AS genotyped", "CAST(NULL AS bigint) AS imputed", "CAST(NULL AS double) AS rate", "f.sha256 AS sha256")
    return counts.unionAll(files)


@query("region_page_by_cursor", """
WITH r AS (SELECT rsid, chromosome, position, ref_allele, alt_allele, user_dosage, user_quality FROM g_merged WHERE chromosome = 3 AND position BETWEEN 20000 AND 200000),
n AS (SELECT *, row_number() OVER (ORDER BY position, ref_allele, alt_allele) AS n FROM r WHERE user_quality IS NULL OR user_quality >= 0.5)
SELECT (n - 1) // 20 + 1 AS page, rsid, chromosome, position, ref_allele, alt_allele, user_dosage, (SELECT count(*) FROM r) AS region_rows FROM n WHERE n <= 60""")
def _(t):
    """The first three pages, each from the cursor that the page before it left."""
    table = ZoneTable(t.spark, staged_path(t.spark, "zones"))
    table.write(merged(t).select("rsid", *SITE_KEY, "user_dosage", "user_quality"), file_rows=500)
    region, keep = (3, 20_000, 200_000), passes_quality("user_quality", 0.5)
    total, cursor, pages = F.lit(table.region_count(*region)), None, []
    for number in (1, 2, 3):
        page, cursor = table.page(*region, size=20, after=cursor, keep=keep)
        pages.append(page.select(F.lit(number).cast("bigint").alias("page"), "rsid", *SITE_KEY, "user_dosage", total.cast("bigint").alias("region_rows")))
        if cursor is None:
            break
    return reduce(DataFrame.unionAll, pages)


@query("region_rows_by_index", """
SELECT c.chromosome, CAST(count(m.position) AS BIGINT) AS variants, coalesce(round(sum(m.user_dosage), 6), 0) AS dosage_sum
FROM (SELECT CAST(range AS INTEGER) AS chromosome FROM range(1, 23)) c LEFT JOIN g_merged m ON m.chromosome = c.chromosome AND m.position BETWEEN 15000 * c.chromosome AND 90000 * c.chromosome
GROUP BY 1""")
def _(t):
    """One region of each chromosome, all from one opening of the files that any of them meets."""
    table = ZoneTable(t.spark, staged_path(t.spark, "zones"))
    table.write(merged(t).select(*SITE_KEY, "user_dosage"), file_rows=500)
    regions = [(c, 15_000 * c, 90_000 * c) for c in range(1, 23)]
    rows = table.regions(regions).groupBy("chromosome").agg(F.count("*").alias("variants"), r6(F.sum("user_dosage")).alias("dosage_sum"))
    every = t.spark.range(1, 23).select(F.col("id").cast("int").alias("chromosome"))
    return every.join(rows, "chromosome", "left").select(
        "chromosome", F.coalesce("variants", F.lit(0)).alias("variants"), F.coalesce("dosage_sum", F.lit(0.0)).alias("dosage_sum"))
