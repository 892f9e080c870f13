"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
Every query runs over its whole tables; results go to Spark's no-op sink. BENCH_COPIES=40 adds
a full merge of 40 times the variants (6 million at sf0.1) with Parquet and VCF output.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import functions as F

from locusloom.operators.merge import DEFAULT_RULES, merge_multi_sample
from locusloom.plans import catalog, registry
from locusloom.plans.derived import CALL_ORDER, Tables
from locusloom.session import build_session, stage
from locusloom.sinks import tables, vcf

HEADLINE = [
    "merge_multi_sample", "merge_worker_rules", "merge_library_rules", "merge_single_sample", "long_table", "vcf_lines",
    "run_statistics_by_chromosome", "relational_variants", "mean_dosage", "genotype_distribution",
    "parse_call_lines", "parse_vcf_lines", "panel_from_json", "describe_quality_by_chromosome", "best_per_rsid",
    "call_summary_by_chromosome", "pgs_zscore", "pgs_percentile", "pgs_raw_scores", "pgs_results",
    "compare_runs", "quality_report", "job_statistics", "download_statistics", "failed_downloads", "rate_limited_per_minute",
]


class CopiedTables(Tables):
    """Orders and line items several times over, every copy with keys of its own."""

    def __init__(self, spark, sf_dir: str, copies: int):
        super().__init__(spark, sf_dir)
        self.copies = copies

    def base(self, name: str):
        rows = super().base(name)
        key = {"orders": "o_orderkey", "lineitem": "l_orderkey"}.get(name)
        if key is None:
            return rows
        cores = self.spark.sparkContext.defaultParallelism
        shifts = F.explode(F.sequence(F.lit(0), F.lit(self.copies - 1)))
        copied = rows.repartition(cores * 2, key).select("*", shifts.alias("_copy"))
        return copied.withColumn(key, F.col(key) + F.col("_copy").cast("bigint") * 10_000_000).drop("_copy")


def full_merge(spark, sf_dir: str, copies: int) -> dict:
    """Merge and write the long Parquet table and the VCF text, with ``copies`` times the variants."""
    out = tempfile.mkdtemp(prefix="bench-")
    t = CopiedTables(spark, sf_dir, copies)
    started = time.perf_counter()
    merged = stage(merge_multi_sample(t.panel(), t.calls(), t.imputed(), DEFAULT_RULES, CALL_ORDER, CALL_ORDER), "merged")
    merge_seconds = time.perf_counter() - started
    tables.write_long_parquet(merged, f"{out}/long", staged=True)
    parquet_seconds = time.perf_counter() - started - merge_seconds
    vcf.write_merged_vcf(merged, f"{out}/vcf", vcf.multi_sample_header("20250101"), staged=True)
    total = time.perf_counter() - started
    return {
        "panel_variants": t.panel().count(), "merged_variants": merged.count(), "merge_sec": round(merge_seconds, 1),
        "parquet_sec": round(parquet_seconds, 1), "vcf_sec": round(total - merge_seconds - parquet_seconds, 1), "total_sec": round(total, 1)}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["merge_counters"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start-up
    seconds = {}
    for name in names:
        started = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    variants = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    merged = registry.merged(Tables(spark, sf_dir)).count()
    out = {"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
           "sf": sf_dir.rsplit("sf", 1)[-1], "cpus": int(cpus), "panel_variants": variants, "merged_variants": merged}
    if "long_table" in seconds:
        out["merged_variants_per_sec_51_samples"] = round(merged / seconds["long_table"])
    if copies := int(os.environ.get("BENCH_COPIES", "0")):
        out["full_merge"] = full_merge(spark, sf_dir, copies)
    print(json.dumps(out))


if __name__ == "__main__":
    main()
