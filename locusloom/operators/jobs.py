"""Views over job, file, audit and progress tables.

``as_of`` is a timestamp literal (text) or Column that stands for "now".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusloom.functions.text import audit_severity, is_email, is_security_event, vcf_layout


def _moment(as_of: str | Column) -> Column:
    return F.lit(as_of).cast("timestamp_ntz") if isinstance(as_of, str) else as_of


def _ago(as_of: str | Column, **interval: int) -> Column:
    return _moment(as_of) - F.make_dt_interval(**{k: F.lit(v) for k, v in interval.items()})


def seconds_between(start: str, end: str) -> Column:
    """Elapsed seconds with fractions."""
    return F.timestamp_diff("MICROSECOND", F.col(start), F.col(end)) / F.lit(1e6)


def job_statistics(jobs: DataFrame) -> DataFrame:
    """Per user: jobs by status, mean processing seconds of completed jobs, newest creation."""
    status = F.col("status")
    done = status == "completed"
    return jobs.groupBy("user_id").agg(
        F.count("*").alias("total_jobs"), F.count_if(done).alias("completed_jobs"),
        F.count_if(status == "failed").alias("failed_jobs"), F.count_if(status == "processing").alias("processing_jobs"),
        F.avg(F.when(done, seconds_between("started_at", "completed_at"))).alias("avg_processing_time_seconds"),
        F.max("created_at").alias("last_job_created_at"))


def file_types(files: DataFrame, job_id=None) -> DataFrame:
    """Distinct lower-cased file types per job, or of one job."""
    rows = files if job_id is None else files.filter(F.col("job_id") == job_id)
    return rows.select("job_id", F.lower("file_type").alias("file_type")).distinct()


def job_progress(jobs: DataFrame) -> DataFrame:
    """Progress shown for a status: 0, 50, 100; anything unknown counts as waiting."""
    s = F.col("status")
    return jobs.withColumns({
        "shown_status": F.when(s == "processing", "processing").when(s.isin("complete", "completed"), "complete")
        .when(s == "failed", "failed").otherwise("queued"),
        "progress": F.when(s == "processing", 50.0).when(s.isin("complete", "completed"), 100.0).otherwise(0.0),
    })


def with_layout(jobs: DataFrame) -> DataFrame:
    return jobs.withColumn("vcf_format", vcf_layout("metadata"))


def invalid_emails(jobs: DataFrame) -> DataFrame:
    """Jobs whose address breaks the format rule; no address is allowed."""
    return jobs.filter(F.col("user_email").isNotNull() & ~is_email("user_email"))


def with_severity(events: DataFrame) -> DataFrame:
    return events.withColumn("severity", audit_severity("event_type"))


def recent_audit(audit: DataFrame, as_of: str | Column, hours: int = 24) -> DataFrame:
    """Events of the last hours up to ``as_of``, newest first; the id breaks ties so that equal times can be split."""
    return audit.filter((F.col("timestamp") > _ago(as_of, hours=hours)) & (F.col("timestamp") <= _moment(as_of))).orderBy(F.desc("timestamp"), F.desc("id"))


def security_events(audit: DataFrame) -> DataFrame:
    """Warning or critical events and failures or denials; works on a stream as well."""
    return audit.filter(is_security_event("event_type", "severity"))


def newest_first(df: DataFrame, column: str = "timestamp", tie: str = "id") -> DataFrame:
    return df.orderBy(F.desc(column), F.desc(tie))


def complete_jobs(jobs: DataFrame, finished_ids: DataFrame, as_of: str | Column, hours: int = 24) -> DataFrame:
    """Set the named jobs to completed; a job that was not completed before expires in ``hours``."""
    done = finished_ids.select("id").distinct().withColumn("_done", F.lit(True))
    now = _moment(as_of)
    newly = F.col("_done") & (F.col("status") != "completed")
    rows = jobs.join(done, "id", "left").withColumn("_new", F.coalesce(newly, F.lit(False)))
    return rows.withColumns({
        "expires_at": F.when(F.col("_new"), now + F.make_dt_interval(hours=F.lit(hours))).otherwise(F.col("expires_at")),
        "completed_at": F.when(F.col("_new"), now).otherwise(F.col("completed_at")),
        "status": F.when(F.col("_new"), F.lit("completed")).otherwise(F.col("status")),
    }).select(*jobs.columns)


def expire_jobs(jobs: DataFrame, as_of: str | Column) -> DataFrame:
    """Completed jobs past their expiry get status expired; ``newly_expired`` marks them."""
    over = (F.col("status") == "completed") & F.col("expires_at").isNotNull() & (F.col("expires_at") < _moment(as_of))
    return jobs.withColumn("newly_expired", over).withColumn(
        "status", F.when(F.col("newly_expired"), F.lit("expired")).otherwise(F.col("status")))


def expired_count(jobs: DataFrame, as_of: str | Column) -> DataFrame:
    return expire_jobs(jobs, as_of).agg(F.count_if("newly_expired").alias("expired"))


def stuck_jobs(jobs: DataFrame, as_of: str | Column, minutes: int = 10) -> DataFrame:
    return jobs.filter((F.col("status") == "processing") & (F.col("started_at") < _ago(as_of, mins=minutes)))


def retention_list(jobs: DataFrame, as_of: str | Column, hours: int = 24) -> DataFrame:
    """Finished jobs old enough to delete; deleting is up to the caller."""
    return jobs.filter(F.col("status").isin("completed", "failed") & (F.col("completed_at") < _ago(as_of, hours=hours)))


def jobs_needing_email(jobs: DataFrame) -> DataFrame:
    return jobs.filter((F.col("status") == "completed") & F.col("emailed_at").isNull())


def chromosome_progress(chromosome: str | Column) -> Column:
    """Percentage after a chromosome: 60 to 85."""
    c = F.col(chromosome) if isinstance(chromosome, str) else chromosome
    return F.lit(60.0) + c / F.lit(22.0) * F.lit(25.0)


def latest_progress(progress: DataFrame) -> DataFrame:
    """Newest message per job; works on a stream in update mode."""
    rest = [c for c in progress.columns if c not in ("job_id", "timestamp")]
    best = progress.groupBy("job_id").agg(F.max(F.struct("timestamp", *rest)).alias("_p"))
    return best.select("job_id", *[F.col(f"_p.{c}").alias(c) for c in progress.columns if c != "job_id"])
