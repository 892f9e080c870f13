"""Queries over jobs, files, audit events, download attempts and progress."""

from __future__ import annotations

from pyspark.sql import functions as F

from locusloom.operators import downloads, jobs
from locusloom.plans.registry import query, r6, rounded, sql_stamp, stamp

JOBS_NOW = "1998-01-01 00:00:00"
AUDIT_NOW = "2024-01-30 00:00:00"


@query("job_statistics", f"""
SELECT user_id, count(*) AS total_jobs, count(*) FILTER (WHERE status = 'completed') AS completed_jobs, count(*) FILTER (WHERE status = 'failed') AS failed_jobs,
  count(*) FILTER (WHERE status = 'processing') AS processing_jobs,
  round(avg(epoch(completed_at) - epoch(started_at)) FILTER (WHERE status = 'completed'), 6) AS avg_processing_time_seconds,
  {sql_stamp('max(created_at)')} AS last_job_created_at FROM g_jobs GROUP BY 1""")
def _(t):
    return rounded(jobs.job_statistics(t.jobs()), "avg_processing_time_seconds").withColumn("last_job_created_at", stamp("last_job_created_at"))


@query("job_file_types", "SELECT DISTINCT job_id, lower(file_type) AS file_type FROM g_files")
def _(t):
    return jobs.file_types(t.files())


@query("job_progress", """
SELECT id, CASE status WHEN 'processing' THEN 'processing' WHEN 'completed' THEN 'complete' WHEN 'failed' THEN 'failed' ELSE 'queued' END AS shown_status,
  CASE status WHEN 'processing' THEN 50.0 WHEN 'completed' THEN 100.0 ELSE 0.0 END::DOUBLE AS progress FROM g_jobs""")
def _(t):
    return jobs.job_progress(t.jobs()).select("id", "shown_status", "progress")


@query("job_vcf_layout", "SELECT CASE WHEN id % 5 = 0 THEN 'per_chromosome' ELSE 'merged' END AS vcf_format, count(*) AS jobs FROM g_jobs GROUP BY 1")
def _(t):
    return jobs.with_layout(t.jobs()).groupBy("vcf_format").agg(F.count("*").alias("jobs"))


@query("invalid_emails", "SELECT id, CASE WHEN id % 4 = 0 THEN replace(user_email, '@', ' at ') ELSE 'x@y' END AS user_email FROM g_jobs WHERE user_email IS NOT NULL AND (id % 4 = 0 OR id % 9 = 0)")
def _(t):
    e = F.col("user_email")
    broken = F.when(F.col("id") % 4 == 0, F.regexp_replace(e, "@", " at ")).when(e.isNotNull() & (F.col("id") % 9 == 0), F.lit("x@y")).otherwise(F.upper(e))
    return jobs.invalid_emails(t.jobs().withColumn("user_email", broken)).select("id", "user_email")


@query("audit_severity", """
SELECT event_type, CASE WHEN event_type = 'access_denied' THEN 'warning' WHEN event_type = 'job_failed' THEN 'error' ELSE 'info' END AS severity, count(*) AS events
FROM g_audit GROUP BY ALL""")
def _(t):
    return jobs.with_severity(t.audit()).groupBy("event_type", "severity").agg(F.count("*").alias("events"))


@query("recent_audit", f"SELECT id, {sql_stamp('timestamp')} AS at, event_type, severity FROM g_audit WHERE timestamp > TIMESTAMP '{AUDIT_NOW}' - INTERVAL 24 HOUR AND timestamp <= TIMESTAMP '{AUDIT_NOW}'")
def _(t):
    return jobs.recent_audit(t.audit(), AUDIT_NOW).select("id", stamp("timestamp").alias("at"), "event_type", "severity")


@query("security_events", f"""
SELECT id, {sql_stamp('timestamp')} AS at, event_type, severity FROM g_audit
WHERE severity IN ('warning', 'critical') OR event_type LIKE '%failure' OR event_type LIKE '%denied'""")
def _(t):
    return jobs.newest_first(jobs.security_events(t.audit())).select("id", stamp("timestamp").alias("at"), "event_type", "severity")


@query("complete_jobs", f"""
SELECT id, CASE WHEN hit THEN 'completed' ELSE status END AS status,
  {sql_stamp(f"CASE WHEN hit AND status <> 'completed' THEN TIMESTAMP '{JOBS_NOW}' + INTERVAL 24 HOUR ELSE expires_at END")} AS expires_at
FROM (SELECT *, id % 6 = 0 AS hit FROM g_jobs)""")
def _(t):
    done = t.jobs().filter("id % 6 = 0").select("id")
    return jobs.complete_jobs(t.jobs(), done, JOBS_NOW).select("id", "status", stamp("expires_at").alias("expires_at"))


@query("expire_jobs", f"""
SELECT id, CASE WHEN gone THEN 'expired' ELSE status END AS status, gone AS newly_expired
FROM (SELECT *, status = 'completed' AND coalesce(expires_at < TIMESTAMP '{JOBS_NOW}', FALSE) AS gone FROM g_jobs)""")
def _(t):
    return jobs.expire_jobs(t.jobs(), JOBS_NOW).select("id", "status", "newly_expired")


@query("expired_count", f"SELECT count(*) AS expired FROM g_jobs WHERE status = 'completed' AND expires_at < TIMESTAMP '{JOBS_NOW}'")
def _(t):
    return jobs.expired_count(t.jobs(), JOBS_NOW)


@query("stuck_jobs", f"SELECT id, user_id FROM g_jobs WHERE status = 'processing' AND started_at < TIMESTAMP '{JOBS_NOW}' - INTERVAL 10 MINUTE")
def _(t):
    return jobs.stuck_jobs(t.jobs(), JOBS_NOW).select("id", "user_id")


@query("retention_list", f"SELECT id, status FROM g_jobs WHERE status IN ('completed', 'failed') AND completed_at < TIMESTAMP '{JOBS_NOW}' - INTERVAL 24 HOUR")
def _(t):
    return jobs.retention_list(t.jobs(), JOBS_NOW).select("id", "status")


@query("jobs_needing_email", "SELECT id, user_email FROM g_jobs WHERE status = 'completed' AND emailed_at IS NULL")
def _(t):
    return jobs.jobs_needing_email(t.jobs()).select("id", "user_email")


@query("latest_progress", f"""
SELECT job_id, round(60 + chromosome / 22.0 * 25, 6) AS progress_pct, message, {sql_stamp('ts')} AS at FROM (
  SELECT CAST(user_id AS VARCHAR) AS job_id, CAST(event_id % 22 + 1 AS INTEGER) AS chromosome, 'event ' || event_id AS message, ts,
    row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id % 22 DESC, 'event ' || event_id DESC) AS rn FROM events) WHERE rn = 1""")
def _(t):
    newest = jobs.latest_progress(t.progress())
    return newest.select("job_id", r6(jobs.chromosome_progress("chromosome")).alias("progress_pct"), "message", stamp("timestamp").alias("at"))


# -- downloads -------------------------------------------------------------------------

@query("jobs_with_attempts", """
SELECT j.id, j.status, count(a.id) AS attempts, count(*) FILTER (WHERE attempt_result = 'success') AS successes,
  count(*) FILTER (WHERE attempt_result = 'invalid_password') AS wrong_passwords, count(*) FILTER (WHERE attempt_result = 'max_attempts_exceeded') AS lockouts
FROM g_jobs j LEFT JOIN g_attempts a ON a.job_id = j.id GROUP BY 1, 2""")
def _(t):
    return downloads.jobs_with_attempts(t.jobs(), t.attempts()).select("id", "status", "attempts", "successes", "wrong_passwords", "lockouts")


_STATS = f"""
SELECT user_email, count(DISTINCT j.id) AS total_jobs_with_downloads, count(DISTINCT CASE WHEN j.download_attempts > 0 THEN j.id END) AS jobs_with_attempts,
  {{total}} AS total_download_attempts,
  count(DISTINCT a.id) FILTER (WHERE attempt_result = 'success') AS successful_downloads,
  count(DISTINCT a.id) FILTER (WHERE attempt_result = 'invalid_password') AS failed_password_attempts,
  count(DISTINCT a.id) FILTER (WHERE attempt_result = 'max_attempts_exceeded') AS locked_out_jobs, {sql_stamp('max(emailed_at)')} AS last_email_sent
FROM g_jobs j LEFT JOIN g_attempts a ON a.job_id = j.id WHERE user_email IS NOT NULL GROUP BY 1"""


@query("download_statistics_as_joined", _STATS.format(total="CAST(sum(j.download_attempts) AS BIGINT)"))
def _(t):
    return downloads.download_statistics(t.jobs(), t.attempts(), inflated=True).withColumn("last_email_sent", stamp("last_email_sent"))


@query("download_statistics", f"""
SELECT s.* EXCLUDE (total_download_attempts), t.total_download_attempts FROM ({_STATS.format(total="0")}) s
JOIN (SELECT user_email, CAST(sum(download_attempts) AS BIGINT) AS total_download_attempts FROM g_jobs GROUP BY 1) t USING (user_email)""")
def _(t):
    return downloads.download_statistics(t.jobs(), t.attempts()).withColumn("last_email_sent", stamp("last_email_sent"))


@query("failed_downloads", f"""
SELECT a.id AS attempt_id, {sql_stamp('attempted_at')} AS attempted_at, ip_address, 'unknown' AS user_agent, attempt_result, user_email, job_id, download_attempts, max_download_attempts
FROM g_attempts a JOIN g_jobs j ON j.id = a.job_id WHERE attempt_result <> 'success'""")
def _(t):
    rows = downloads.failed_downloads(t.attempts(), t.jobs())
    return jobs.newest_first(rows, "attempted_at", "attempt_id").withColumn("attempted_at", stamp("attempted_at"))


@query("rate_limited_per_minute", f"""
SELECT job_id, {sql_stamp('attempted_at')} AS attempted_at, count(*) AS n, prior, prior >= 3 AS rate_limited FROM (
  SELECT job_id, attempted_at, count(*) OVER (PARTITION BY job_id ORDER BY epoch_us(attempted_at) RANGE BETWEEN 3599999999 PRECEDING AND 1 PRECEDING) AS prior
  FROM g_attempts) GROUP BY job_id, attempted_at, prior""")
def _(t):
    # The test events are minutes apart: an hour instead of a minute.
    return downloads.rate_limited_per_minute(t.attempts(), seconds=3600).withColumn("attempted_at", stamp("attempted_at"))


@query("attempts_too_soon", f"""
SELECT job_id, {sql_stamp('attempted_at')} AS attempted_at, coalesce(gap < 1200000000, FALSE) AS too_soon FROM (
  SELECT job_id, attempted_at, epoch_us(attempted_at) - lag(epoch_us(attempted_at)) OVER (PARTITION BY job_id ORDER BY attempted_at) AS gap
  FROM (SELECT DISTINCT job_id, attempted_at FROM g_attempts))""")
def _(t):
    return downloads.too_soon(t.attempts(), seconds=1200).select("job_id", stamp("attempted_at").alias("attempted_at"), "too_soon")


@query("download_allowed", f"""
SELECT j.id, j.status = 'completed' AND (expires_at IS NULL OR expires_at >= TIMESTAMP '{JOBS_NOW}') AND download_attempts < max_download_attempts
  AND NOT (last_download_attempt IS NOT NULL AND (SELECT count(*) FROM g_attempts a WHERE a.job_id = j.id AND attempted_at > TIMESTAMP '{JOBS_NOW}' - INTERVAL 1 MINUTE
    AND attempted_at <= TIMESTAMP '{JOBS_NOW}') >= 3) AS allowed
FROM g_jobs j""".replace("g_attempts", "(SELECT job_id % 40 AS job_id, attempted_at - INTERVAL 9510 DAY AS attempted_at FROM g_attempts)"))
def _(t):
    moved = t.attempts().withColumn("job_id", F.col("job_id") % 40).withColumn("attempted_at", F.expr("attempted_at - INTERVAL '9510' DAY"))
    return downloads.download_allowed(t.jobs(), moved, JOBS_NOW).select("id", "allowed")


@query("classify_attempts", """
SELECT id, CASE WHEN status <> 'completed' THEN 'job_not_found' WHEN expires_at < attempted_at THEN 'job_expired' WHEN download_attempts >= 5 THEN 'max_attempts_exceeded'
  WHEN epoch_us(attempted_at) - epoch_us(last_download_attempt) < 20000000 THEN 'rate_limited' WHEN NOT password_valid THEN 'invalid_password' ELSE 'success' END AS attempt_result
FROM (SELECT *, completed_at + INTERVAL (id * 11 % 90000) SECOND AS attempted_at, id % 3 <> 0 AS password_valid FROM g_jobs)""")
def _(t):
    at = F.expr("timestampadd(SECOND, cast(id * 11 % 90000 as int), completed_at)")
    rows = t.jobs().withColumn("attempted_at", at).withColumn("password_valid", F.col("id") % 3 != 0)
    return downloads.classify_attempts(rows).select("id", "attempt_result")


@query("attempt_deletion_audit", """
SELECT CAST(id AS VARCHAR) AS download_attempt_id, CAST(job_id AS VARCHAR) AS job_id, attempt_result, 'job_cleanup' AS event_type, 'info' AS severity FROM g_attempts WHERE id % 10 = 3""")
def _(t):
    gone = downloads.deletion_audit(t.attempts(), t.attempts().filter("id % 10 <> 3"), AUDIT_NOW)
    d = F.from_json("details", "download_attempt_id string, job_id string, attempt_result string")
    return gone.select(d.alias("d"), "event_type", "severity").select("d.*", "event_type", "severity")
