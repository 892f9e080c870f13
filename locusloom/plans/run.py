"""The whole run: input folder to merged frame, outputs, counters and register."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusloom.functions.text import parse_formats
from locusloom.operators.dedup import last_wins
from locusloom.operators.merge import DEFAULT_RULES, MergeRules, autosomal, merge_counters, merge_multi_sample
from locusloom.operators.pgs import scale_pgs
from locusloom.operators.stats import run_statistics
from locusloom.schemas import SITE_KEY
from locusloom.session import Staging, configure, stage
from locusloom.sinks import tables, vcf
from locusloom.sources.calls import read_calls
from locusloom.sources.files import classify_files, list_files, output_register
from locusloom.sources.lines import LINE_ORDER
from locusloom.sources.panel import read_panel
from locusloom.sources.pgs import read_pgs_scores
from locusloom.sources.vcf import DEFAULT_MAX_ERRORS, read_vcf


@dataclass
class RunOptions:
    job_id: str
    user_id: str
    processing_date: str
    rules: MergeRules = DEFAULT_RULES
    formats: list[str] | None = None
    vcf_layout: str = "merged"
    user_sample_name: str = "samp51"
    max_errors: int = DEFAULT_MAX_ERRORS
    quality_tags: tuple[str, ...] = ("R2",)
    names: dict[str, str] = field(default_factory=dict)


@dataclass
class RunResult:
    merged: DataFrame
    counters: DataFrame
    statistics: DataFrame
    metadata: DataFrame
    register: DataFrame
    scored: DataFrame | None
    rejects: DataFrame
    staging: Staging

    def release(self) -> None:
        """Remove the run's staged tables; the frames above can't be read afterwards, the written outputs can."""
        self.staging.drop()


def find_inputs(spark: SparkSession, folder: str) -> dict[str, list[str]]:
    """Paths by type. The list goes to the driver, as any multi-path read needs it."""
    rows = classify_files(list_files(spark, folder)).filter(F.col("file_type") != "other").select("file_type", "path").collect()
    found: dict[str, list[str]] = {"genome": [], "vcf": [], "pgs": []}
    for row in sorted(rows, key=lambda r: r.path):
        found[row.file_type].append(row.path)
    if not found["genome"]:
        raise FileNotFoundError(f"no calls file in {folder}")
    return found


def run_merge(spark: SparkSession, input_folder: str, panel_path: str, output_folder: str, options: RunOptions) -> RunResult:
    """Read, merge once, and write every requested format from the merged table.

    Calls and imputed rows are made unique and staged in the shared folder, so the merge joins
    plain scans: Spark then knows their sizes and can split skewed partitions on either side.
    The staged tables belong to the result, whose ``release`` removes them; a run that fails removes its own.
    """
    configure(spark)
    with Staging(spark) as staging:
        return _run(spark, input_folder, panel_path, output_folder, options, staging)


def _run(spark: SparkSession, input_folder: str, panel_path: str, output_folder: str, options: RunOptions, staging: Staging) -> RunResult:
    formats = parse_formats(options.formats)
    inputs = find_inputs(spark, input_folder)

    calls = autosomal(read_calls(spark, inputs["genome"]))
    calls_keys = ["chromosome", "position"] if options.rules.call_match == "position" else ["chromosome", "position", "genotype"]
    payload = ["rsid", "genotype"]
    if options.rules.call_match == "position":
        calls = stage(last_wins(calls, calls_keys, LINE_ORDER, payload), "calls")
    if inputs["vcf"]:
        read = read_vcf(spark, inputs["vcf"], max_errors=options.max_errors, quality_tags=options.quality_tags)
        imputed, rejects = read.rows, read.rejects
    else:
        raise FileNotFoundError(f"no VCF file in {input_folder}")
    rules = options.rules
    if rules.call_match == "position" and rules.key == "site":
        imputed = stage(
            last_wins(imputed, SITE_KEY, LINE_ORDER, ["rsid", "dosage", "imputation_quality"]), "imputed-unique")
        rules = rules.with_(unique_inputs=True)

    panel = read_panel(spark, panel_path)
    merged = stage(merge_multi_sample(panel, calls, imputed, rules), "merged")

    scores = [read_pgs_scores(spark, path) for path in inputs["pgs"]]
    scored = scale_pgs(reduce(DataFrame.unionByName, scores)) if scores else None
    statistics = run_statistics(merged)
    metadata = tables.run_metadata(statistics, options.job_id, options.user_id, options.processing_date, **options.names)
    write_outputs(merged, metadata, scored, output_folder, formats, options)
    counters = merge_counters(read_panel(spark, panel_path, check=False), merged, rules)
    return RunResult(merged, counters, statistics, metadata, output_register(spark, output_folder), scored, rejects, staging)


def write_outputs(
    merged: DataFrame, metadata: DataFrame, scored: DataFrame | None, folder: str, formats: list[str], options: RunOptions,
) -> None:
    if "parquet" in formats:
        tables.write_long_parquet(merged, f"{folder}/parquet", staged=True)
        if scored is not None:
            scored.write.mode("overwrite").parquet(f"{folder}/scores")
    if "vcf" in formats:
        header = vcf.multi_sample_header(options.processing_date[:10].replace("-", ""), options.user_sample_name)
        write = vcf.write_vcf_per_chromosome if options.vcf_layout == "per_chromosome" else vcf.write_merged_vcf
        write(merged, f"{folder}/vcf", header, staged=True)
    if "tables" in formats:
        tables.write_tables(tables.relational_frames(merged, metadata, scored, staged=True), f"{folder}/tables")
    if "json" in formats:
        tables.write_json(merged, metadata, f"{folder}/json", scored, staged=True)
