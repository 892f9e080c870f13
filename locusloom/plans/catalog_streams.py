"""Streaming queries, run over the whole tables with ``availableNow`` and read back from the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusloom.operators.dedup import last_wins
from locusloom.operators.jobs import chromosome_progress
from locusloom.operators.merge import autosomal, unique_imputed
from locusloom.plans.derived import CALL_ORDER, Tables
from locusloom.plans.registry import query, r6, sql_stamp, stamp
from locusloom.schemas import SITE_KEY
from locusloom.session import staged_path
from locusloom.sinks.tables import by_place
from locusloom.streaming import monitors
from locusloom.streaming.chromosomes import ChromosomeFeed


def _event_stream(t: Tables) -> DataFrame:
    """The events table as a stream, in the shape of attempts and audit events."""
    spark = t.spark
    schema = spark.read.parquet(f"{t.sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)


def _drain(stream: DataFrame, name: str) -> DataFrame:
    """Run an append-mode stream to its end and read what it wrote."""
    spark = stream.sparkSession
    out = staged_path(spark, name)
    running = stream.writeStream.format("parquet").option("path", f"{out}/rows").option(
        "checkpointLocation", f"{out}/progress").outputMode("append").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


def _final(stream: DataFrame, name: str) -> DataFrame:
    """Run an aggregating stream to its end in complete mode and read its last result."""
    spark = stream.sparkSession
    out = staged_path(spark, name)

    def keep(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/rows")

    stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{out}/progress").outputMode("complete").trigger(
        availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


@query("stream_security_events", f"""
SELECT id, {sql_stamp('timestamp')} AS at, event_type, severity FROM g_audit
WHERE severity IN ('warning', 'critical') OR event_type LIKE '%failure' OR event_type LIKE '%denied'""")
def _(t):
    e, n = F.col("event_type"), F.col("event_id") % 4
    audit = _event_stream(t).select(
        F.col("event_id").alias("id"), F.col("ts").alias("timestamp"),
        F.when(e == "error", "login_failure").when(e == "click", "access_denied").when(e == "view", "file_uploaded")
        .when(e == "signup", "job_failed").otherwise("job_completed").alias("event_type"),
        F.when(n == 0, "info").when(n == 1, "warning").when(n == 2, "error").otherwise("critical").alias("severity"))
    return _drain(monitors.security_stream(audit), "security").select("id", stamp("timestamp").alias("at"), "event_type", "severity")


@query("stream_exact_gate", f"""
SELECT CAST(id AS VARCHAR) AS id, CAST(job_id AS VARCHAR) AS job_id, prior, prior >= 3 AS rate_limited FROM (
  SELECT id, job_id, count(*) OVER (PARTITION BY job_id ORDER BY epoch_us(attempted_at) RANGE BETWEEN 3599999999 PRECEDING AND 1 PRECEDING) AS prior FROM g_attempts)""")
def _(t):
    attempts = _event_stream(t).select(
        F.col("event_id").alias("id"), F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("attempted_at"))
    return _drain(monitors.exact_gate(attempts, seconds=3600), "gate").drop("attempted_at")


@query("stream_chromosome_merge", """
SELECT chromosome, user_source, count(*) AS variants, round(sum(user_dosage), 6) AS dosage_sum FROM g_merged GROUP BY 1, 2""")
def _(t):
    spark = t.spark
    folder = staged_path(spark, "feed")
    rows = unique_imputed(t.imputed(), SITE_KEY, CALL_ORDER)
    info = F.coalesce(F.concat(F.lit("R2="), F.col("imputed_r2").cast("string")), F.lit("."))
    line = F.concat_ws(
        "\t", F.col("chromosome").cast("string"), F.col("position").cast("string"), F.lit("."), "ref_allele", "alt_allele",
        F.lit("."), F.lit("PASS"), info, F.lit("GT:DS"), F.concat(F.lit("0|0:"), F.col("imputed_dosage").cast("string")))
    # VCF text in one folder per chromosome, as it would arrive.
    by_place(rows).select("chromosome", line.alias("value")).write.partitionBy("chromosome").text(f"{folder}/arriving")
    calls = last_wins(autosomal(t.calls()), ["chromosome", "position"], CALL_ORDER, ["rsid", "genotype"])
    feed = ChromosomeFeed(spark, t.panel(), calls, f"{folder}/table")
    feed.initialise()
    feed.start(f"{folder}/arriving", f"{folder}/progress").awaitTermination()
    return feed.merged().groupBy("chromosome", "user_source").agg(
        F.count("*").alias("variants"), F.round(F.sum("user_dosage"), 6).alias("dosage_sum"))


@query("stream_merge_of_raw_batches", """
SELECT chromosome, position, ref_allele, alt_allele, user_genotype, user_dosage, user_source FROM g_merged""")
def _(t):
    """Raw rows, repeated keys and all, arrive in three batches in order of date; the last line of a site counts."""
    spark, folder = t.spark, staged_path(t.spark, "raw-feed")
    feed = ChromosomeFeed(spark, t.panel(), last_wins(autosomal(t.calls()), ["chromosome", "position"], CALL_ORDER, ["rsid", "genotype"]), f"{folder}/table")
    feed.initialise()
    info = F.coalesce(F.concat(F.lit("R2="), F.col("imputation_quality").cast("string")), F.lit("."))
    line = F.concat_ws(
        "\t", F.col("chromosome").cast("string"), F.col("position").cast("string"), F.lit("."), "ref_allele", "alt_allele",
        F.lit("."), F.lit("PASS"), info, F.lit("GT:DS"), F.concat(F.lit("0|0:"), F.col("dosage").cast("string")))
    rows = t.imputed().orderBy(*CALL_ORDER, "dosage")  # part files in name order are lines in order
    year = F.year("l_shipdate")
    for n, batch in enumerate((year < 1994, (year >= 1994) & (year < 1996), year >= 1996)):
        rows.filter(batch).select(line.alias("value")).write.text(f"{folder}/arriving/{n}")
        feed.start(f"{folder}/arriving/*", f"{folder}/progress").awaitTermination()
    return feed.merged().select(*SITE_KEY, "user_genotype", "user_dosage", "user_source")


@query("stream_sliding_attempts", """
WITH windows AS (SELECT CAST(job_id AS VARCHAR) AS job_id, (epoch_us(attempted_at) // 10000000 - unnest(range(6))) * 10 AS window_second FROM g_attempts)
SELECT job_id, window_second, count(*) AS attempts, count(*) >= 3 AS busy FROM windows GROUP BY 1, 2""")
def _(t):
    attempts = _event_stream(t).select(
        F.col("user_id").cast("string").alias("job_id"), F.col("ts").cast("timestamp").alias("attempted_at"))
    windows = _final(monitors.sliding_attempts(attempts), "sliding")
    return windows.select("job_id", F.unix_seconds("window_start").alias("window_second"), "attempts", "busy")


@query("stream_progress", f"""
SELECT job_id, round(60 + chromosome / 22.0 * 25, 6) AS progress_pct, message, {sql_stamp('ts')} AS at FROM (
  SELECT CAST(user_id AS VARCHAR) AS job_id, CAST(event_id % 22 + 1 AS INTEGER) AS chromosome, 'event ' || event_id AS message, ts,
    row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id % 22 DESC, 'event ' || event_id DESC) AS rn FROM events) WHERE rn = 1""")
def _(t):
    progress = _event_stream(t).select(
        F.col("user_id").cast("string").alias("job_id"), (F.col("event_id") % 22 + 1).cast("int").alias("chromosome"),
        F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("message"), F.col("ts").alias("timestamp"))
    newest = _final(monitors.progress_stream(progress), "progress")
    return newest.select("job_id", r6(chromosome_progress("chromosome")).alias("progress_pct"), "message", stamp("timestamp").alias("at"))
