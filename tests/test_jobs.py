import datetime as dt
import random

from pyspark.sql import functions as F

from locusloom.operators import downloads, jobs

T0 = dt.datetime(2025, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def test_trailing_counts_by_brute_force(spark):
    """One job has most of the attempts, many at one moment and many around slice borders."""
    rng = random.Random(5)
    span, length = 60, 60 * downloads.SLICE_WINDOWS
    border = (int(T0.timestamp()) // length + 1) * length - int(T0.timestamp())
    times = [("hot", border + rng.uniform(-90, 90)) for _ in range(300)] + [("hot", 500.0)] * 50
    times += [("hot", border + x) for x in (-60, -59.999999, -0.000001, 0, 59.999999, 60)]
    times += [(f"j{rng.randrange(5)}", rng.uniform(0, 3000)) for _ in range(100)]
    rows = [(j, at(s)) for j, s in times]
    df = spark.createDataFrame(rows, "job_id string, attempted_at timestamp_ntz")
    got = {(r.job_id, r.attempted_at): (r.n, r.prior) for r in downloads.trailing_counts(df, "job_id", "attempted_at", span).collect()}
    window = dt.timedelta(seconds=span)
    for j, t in set(rows):
        n = sum(1 for x in rows if x == (j, t))
        prior = sum(1 for k, x in rows if k == j and t - window < x < t)
        assert got[j, t] == (n, prior)
    assert len(got) == len(set(rows))


JOB = ("id bigint, status string, expires_at timestamp_ntz, download_attempts int, max_download_attempts int, "
       "last_download_attempt timestamp_ntz, attempted_at timestamp_ntz, password_valid boolean")


def test_classification_order(spark):
    rows = [
        (1, "processing", at(-1), 9, 5, at(99), at(100), True), (2, "completed", at(99), 9, 5, at(99), at(100), True),
        (3, "completed", at(100), 5, 5, at(99), at(100), True), (4, "completed", None, 4, 5, at(80.000001), at(100), True),
        (5, "completed", None, 4, 5, at(80), at(100), False), (6, "completed", at(101), 0, 5, None, at(100), True),
        (7, "completed", None, 0, 5, None, at(100), None), (8, None, None, 0, 5, None, at(100), True)]
    got = [r.attempt_result for r in downloads.classify_attempts(spark.createDataFrame(rows, JOB)).orderBy("id").collect()]
    assert got == ["job_not_found", "job_expired", "max_attempts_exceeded", "rate_limited", "invalid_password", "success",
                   "invalid_password", "job_not_found"]


def test_download_gate(spark):
    rows = [(i, "completed", None, 0, 5, at(0) if i != 3 else None, None, None) for i in range(1, 5)]
    table = spark.createDataFrame(rows, JOB).drop("attempted_at", "password_valid")
    attempts = [(1, s) for s in (41, 50, 60)] + [(2, s) for s in (40, 50, 60)] + [(3, s) for s in (50, 50, 50)]
    df = spark.createDataFrame([(j, at(s), "success") for j, s in attempts], "job_id bigint, attempted_at timestamp_ntz, attempt_result string")
    got = {r.id: r.allowed for r in downloads.download_allowed(table, df, str(at(100))).collect()}
    # 2 has one attempt exactly a minute old; 3 never recorded an attempt on the job; 4 has none.
    assert got == {1: False, 2: True, 3: True, 4: True}


def test_expiry_and_retention(spark):
    schema = "id bigint, status string, started_at timestamp_ntz, completed_at timestamp_ntz, expires_at timestamp_ntz, emailed_at timestamp_ntz"
    rows = [(1, "completed", at(0), at(10), at(50), None), (2, "completed", at(0), at(10), at(100), at(1)), (3, "failed", at(0), at(10), None, None), (4, "processing", at(0), None, None, None)]
    table = spark.createDataFrame(rows, schema)
    now = str(at(100))
    assert [r.id for r in jobs.expire_jobs(table, now).filter("newly_expired").collect()] == [1]
    assert jobs.expired_count(table, now).first().expired == 1
    done = jobs.complete_jobs(table, spark.createDataFrame([(2,), (4,)], "id bigint"), now)
    got = {r.id: (r.status, r.expires_at) for r in done.collect()}
    assert got[2] == ("completed", at(100)) and got[4] == ("completed", at(100 + 86400))
    late = str(at(86410.5))
    assert sorted(r.id for r in jobs.retention_list(table, late).collect()) == [1, 2, 3]
    assert jobs.retention_list(table, str(at(86410))).count() == 0
    assert [r.id for r in jobs.stuck_jobs(table, str(at(601))).collect()] == [4] and jobs.stuck_jobs(table, str(at(600))).count() == 0
    assert [r.id for r in jobs.jobs_needing_email(table).collect()] == [1]


def test_progress(spark):
    shown = spark.createDataFrame([("pending",), ("processing",), ("completed",), ("failed",), ("expired",)], "status string")
    assert [(r.shown_status, r.progress) for r in jobs.job_progress(shown).collect()] == [
        ("queued", 0.0), ("processing", 50.0), ("complete", 100.0), ("failed", 0.0), ("queued", 0.0)]
    row = shown.limit(1).select(jobs.chromosome_progress(F.lit(11)).alias("p"), jobs.chromosome_progress(F.lit(22)).alias("q")).first()
    assert (row.p, row.q) == (72.5, 85.0)


def test_inflated_statistics(spark):
    table = spark.createDataFrame([(1, "a@b.org", 2, None), (2, "a@b.org", 3, None), (3, None, 9, None)],
                                  "id bigint, user_email string, download_attempts int, emailed_at timestamp_ntz")
    attempts = spark.createDataFrame([(1, at(1), "success")] * 3 + [(1, at(2), "invalid_password")], "job_id bigint, attempted_at timestamp_ntz, attempt_result string")
    plain = downloads.download_statistics(table, attempts).collect()
    assert len(plain) == 1 and plain[0].total_download_attempts == 5 and plain[0].successful_downloads == 3
    assert downloads.download_statistics(table, attempts, inflated=True).first().total_download_attempts == 2 * 4 + 3
