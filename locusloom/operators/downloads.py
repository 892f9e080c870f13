"""Download attempts: rate rules, classification and security reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locusloom.operators.jobs import _ago, _moment

MAX_PER_MINUTE = 3
MIN_GAP_SECONDS = 20


def _micros(ts: str | Column) -> Column:
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


# A slice of time is this many windows long. A busy key is spread over its slices; only rows
# in the last window of a slice are looked at twice.
SLICE_WINDOWS = 16


def time_slices(micros: Column, span: int) -> Column:
    """ARRAY<STRUCT<slice, own>>: the row's own slice and, when it is within ``span`` of the
    slice's end, the next one, where it is context only."""
    length = span * SLICE_WINDOWS
    own = F.floor(micros / length).cast("bigint")
    mine = F.struct(own.alias("slice"), F.lit(True).alias("own"))
    context = F.struct((own + 1).alias("slice"), F.lit(False).alias("own"))
    return F.when(micros >= (own + 1) * length - span, F.array(mine, context)).otherwise(F.array(mine))


def trailing_counts(events: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """Per key and moment: ``n`` events then, and ``prior`` events in the ``seconds`` before it.

    Events of one moment are counted first, then time is cut into slices, so no task sorts all
    of a busy key. What precedes a moment lies in its own slice or is brought in as context.
    """
    span = seconds * 1_000_000
    counts = events.groupBy(key, ts).agg(F.count("*").alias("n")).withColumn("_t", _micros(ts))
    rows = counts.withColumn("_at", F.explode(time_slices(F.col("_t"), span)))
    before = W.partitionBy(key, "_at.slice").orderBy("_t").rangeBetween(-(span - 1), -1)
    return rows.withColumn("prior", F.coalesce(F.sum("n").over(before), F.lit(0))).filter("_at.own").select(key, ts, "n", "prior")


def rate_limited_per_minute(attempts: DataFrame, limit: int = MAX_PER_MINUTE, seconds: int = 60) -> DataFrame:
    """Per job and moment: attempts then, those in the minute before, and whether that blocks."""
    return trailing_counts(attempts, "job_id", "attempted_at", seconds).withColumn("rate_limited", F.col("prior") >= limit)


def too_soon(attempts: DataFrame, seconds: int = MIN_GAP_SECONDS) -> DataFrame:
    """Per job and moment: whether an earlier attempt is less than ``seconds`` back."""
    return trailing_counts(attempts, "job_id", "attempted_at", seconds).withColumn("too_soon", F.col("prior") > 0)


def attempts_per_job(attempts: DataFrame, as_of: str | Column | None = None, seconds: int = 60) -> DataFrame:
    """Attempt counts per job by result, and those in the last ``seconds`` up to ``as_of``."""
    result = F.col("attempt_result")
    recent = F.lit(False) if as_of is None else (
        (F.col("attempted_at") > _ago(as_of, secs=seconds)) & (F.col("attempted_at") <= _moment(as_of)))
    return attempts.groupBy("job_id").agg(
        F.count("*").alias("attempts"), F.count_if(result == "success").alias("successes"),
        F.count_if(result == "invalid_password").alias("wrong_passwords"),
        F.count_if(result == "max_attempts_exceeded").alias("lockouts"), F.count_if(recent).alias("recent"))


def download_allowed(jobs: DataFrame, attempts: DataFrame, as_of: str | Column) -> DataFrame:
    """Per job whether a download may start at ``as_of``: completed, not expired, attempts left,
    and fewer than three attempts in the last minute. A job with no attempt on record skips the last rule.
    """
    recent = attempts_per_job(attempts, as_of).select(F.col("job_id").alias("id"), "recent")
    rows = jobs.join(recent, "id", "left")
    busy = F.col("last_download_attempt").isNotNull() & (F.coalesce("recent", F.lit(0)) >= MAX_PER_MINUTE)
    allowed = (
        (F.col("status") == "completed")
        & F.coalesce(F.col("expires_at") >= _moment(as_of), F.lit(True))
        & (F.col("download_attempts") < F.col("max_download_attempts")) & ~busy
    )
    return rows.select(*jobs.columns, F.coalesce(allowed, F.lit(False)).alias("allowed"))


def classify_attempts(attempts: DataFrame) -> DataFrame:
    """``attempt_result`` by the first rule that applies.

    Needs the job's state at the attempt: status, expires_at, download_attempts,
    max_download_attempts, last_download_attempt, and attempted_at, password_valid.
    """
    since = F.timestamp_diff("MICROSECOND", F.col("last_download_attempt"), F.col("attempted_at"))
    return attempts.withColumn(
        "attempt_result",
        F.when(F.coalesce(F.col("status") != "completed", F.lit(True)), F.lit("job_not_found"))
        .when(F.col("expires_at") < F.col("attempted_at"), F.lit("job_expired"))
        .when(F.col("download_attempts") >= F.col("max_download_attempts"), F.lit("max_attempts_exceeded"))
        .when(since < MIN_GAP_SECONDS * 1_000_000, F.lit("rate_limited"))
        .when(~F.coalesce(F.col("password_valid"), F.lit(False)), F.lit("invalid_password"))
        .otherwise(F.lit("success")))


def jobs_with_attempts(jobs: DataFrame, attempts: DataFrame) -> DataFrame:
    """Every job with its attempts' counts, zero where it has none."""
    counts = attempts_per_job(attempts).drop("recent").withColumnRenamed("job_id", "id")
    rows = jobs.join(counts, "id", "left")
    names = ["attempts", "successes", "wrong_passwords", "lockouts"]
    return rows.select(*jobs.columns, *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


def download_statistics(jobs: DataFrame, attempts: DataFrame, inflated: bool = False) -> DataFrame:
    """Download security counts per e-mail address.

    Attempts are counted per job before the join, so a job with a great many attempts joins as
    one row. ``inflated`` adds a job's counter once per attempt row, as the plain join of both
    tables would; otherwise it is added once.
    """
    rows = jobs_with_attempts(jobs.filter(F.col("user_email").isNotNull()), attempts)
    copies = F.greatest("attempts", F.lit(1)) if inflated else F.lit(1)
    return rows.groupBy("user_email").agg(
        F.count("*").alias("total_jobs_with_downloads"), F.count_if(F.col("download_attempts") > 0).alias("jobs_with_attempts"),
        F.sum(F.col("download_attempts") * copies).cast("bigint").alias("total_download_attempts"),
        F.sum("successes").alias("successful_downloads"), F.sum("wrong_passwords").alias("failed_password_attempts"),
        F.sum("lockouts").alias("locked_out_jobs"), F.max("emailed_at").alias("last_email_sent"))


def failed_downloads(attempts: DataFrame, jobs: DataFrame) -> DataFrame:
    """Unsuccessful attempts with their job's address and counters."""
    failed = attempts.filter(F.col("attempt_result") != "success").withColumnRenamed("id", "attempt_id")
    j = jobs.select(F.col("id").alias("job_id"), "user_email", "download_attempts", "max_download_attempts")
    return failed.join(j, "job_id").select(
        "attempt_id", "attempted_at", "ip_address", "user_agent", "attempt_result", "user_email", "job_id",
        "download_attempts", "max_download_attempts")


def deletion_audit(before: DataFrame, after: DataFrame, as_of: str | Column) -> DataFrame:
    """Audit rows for the attempts that are in the first snapshot and not in the second."""
    gone = before.join(after.select("id"), "id", "left_anti")
    return gone.select(
        _moment(as_of).alias("timestamp"), F.lit("job_cleanup").alias("event_type"), F.lit("system").alias("user_id"),
        F.lit("download_attempt_deleted").alias("action"), F.lit("success").alias("result"),
        F.to_json(F.struct(
            F.col("id").cast("string").alias("download_attempt_id"), F.col("job_id").cast("string").alias("job_id"),
            F.date_format("attempted_at", "yyyy-MM-dd HH:mm:ss").alias("attempted_at"), "attempt_result")).alias("details"),
        F.lit("info").alias("severity"))
