import datetime as dt
import json
import os
import random

import numpy as np
from pyspark.sql import functions as F

from locusloom.operators.merge import DEFAULT_RULES, merge_multi_sample
from locusloom.schemas import ATTEMPTS, AUDIT, PROGRESS
from locusloom.sources.lines import read_lines
from locusloom.sources.vcf import parse_vcf_lines
from locusloom.streaming import monitors
from locusloom.streaming.chromosomes import ChromosomeFeed
from tests.test_merge import CALLS, panel_rows


def put_json(folder, name, rows):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.writelines(json.dumps(r) + "\n" for r in rows)


def drain(stream, folder, mode="append"):
    q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def vcf_line(chromosome, position, ds, r2=0.9):
    return f"{chromosome}\t{position}\t.\tA\tG\t.\tPASS\tR2={r2}\tGT:DS\t0|0:{ds}\n"


def test_incremental_merge_equals_batch(spark, tmp_path):
    arriving = tmp_path / "arriving"
    os.makedirs(arriving)
    panel = panel_rows(spark, [(c, p, None, "A", "G", 0.95) for c in (1, 2, 3) for p in range(1, 21)])
    calls = spark.createDataFrame([("c", "1", 3, "GG", "f", 0, 0)], CALLS)
    feed = ChromosomeFeed(spark, panel, calls, str(tmp_path / "table"))
    feed.initialise()
    assert feed.totals().first().total == 60
    first = "##fileformat=VCFv4.2\n" + "".join(vcf_line(1, p, 0.4) for p in range(1, 11)) + "1\tx\n"
    (arriving / "a.vcf").write_text(first)
    feed.start(str(arriving), str(tmp_path / "cp")).awaitTermination()
    assert feed.missing().count() == 21 and feed.rejects().count() == 1
    (arriving / "b.vcf").write_text("".join(vcf_line(2, p, 1.6) for p in range(5, 9)) + vcf_line(1, 5, 2.0))
    feed.start(str(arriving), str(tmp_path / "cp")).awaitTermination()

    batch = parse_vcf_lines(read_lines(spark, str(arriving))).filter(F.col("error").isNull())
    expected = merge_multi_sample(panel, calls, batch, DEFAULT_RULES)
    streamed = feed.merged().select(*expected.columns)
    assert streamed.exceptAll(expected).count() == 0 and expected.exceptAll(streamed).count() == 0
    assert streamed.filter("chromosome = 1 AND position = 5").first().user_dosage == 2.0
    # A batch that is replayed changes nothing.
    feed.append(spark.read.text(str(arriving / "b.vcf")).select(
        "value", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("split_start")), 1)
    assert feed.merged().select(*expected.columns).exceptAll(expected).count() == 0
    assert feed.received().count() == 15


def test_exact_gate_over_batches(spark, tmp_path):
    rng = random.Random(11)
    t0 = dt.datetime(2025, 1, 1)
    times = sorted(rng.uniform(0, 4000) for _ in range(120))
    rows = [{"id": str(i), "job_id": "hot" if i % 3 else "other", "attempted_at": (t0 + dt.timedelta(seconds=round(t, 6))).isoformat()} for i, t in enumerate(times)]
    for n in range(3):
        put_json(str(tmp_path / "in"), f"{n}.json", rows[n * 40:(n + 1) * 40])
        os.utime(tmp_path / f"in/{n}.json", (1.7e9 + n, 1.7e9 + n))  # files are taken in order of age
    stream = spark.readStream.schema(ATTEMPTS).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    got = {r.id: (r.prior, r.rate_limited) for r in drain(monitors.exact_gate(stream), str(tmp_path)).collect()}
    seen = [(r["id"], r["job_id"], dt.datetime.fromisoformat(r["attempted_at"])) for r in rows]
    for i, j, t in seen:
        prior = sum(1 for _, k, x in seen if k == j and t - dt.timedelta(seconds=60) < x < t)
        assert got[i] == (prior, prior >= 3)
    assert len(got) == 120


def test_gate_takes_jobs_in_groups(spark, tmp_path):
    """Jobs of a few attempts each, one without a name and one busy: few states, and each job's own counts."""
    t0 = dt.datetime(2025, 1, 1)
    rows = [{"id": f"{j}-{n}", "job_id": None if j == 7 else str(j), "attempted_at": (t0 + dt.timedelta(seconds=20 * n + j % 9)).isoformat()}
            for n in range(4) for j in range(300)]
    rows += [{"id": f"busy-{n}", "job_id": "busy", "attempted_at": (t0 + dt.timedelta(milliseconds=100 * n)).isoformat()} for n in range(600)]
    for n in range(2):
        put_json(str(tmp_path / "in"), f"{n}.json", [r for r in rows if (r["attempted_at"] >= (t0 + dt.timedelta(seconds=30)).isoformat()) == bool(n)])
        os.utime(tmp_path / f"in/{n}.json", (1.7e9 + n, 1.7e9 + n))
    stream = spark.readStream.schema(ATTEMPTS).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    got = {r.id: r.prior for r in drain(monitors.exact_gate(stream), str(tmp_path)).collect()}
    times = {}
    for r in rows:
        times.setdefault(r["job_id"], []).append((r["id"], dt.datetime.fromisoformat(r["attempted_at"])))
    minute = dt.timedelta(seconds=60)
    assert got == {i: sum(t - minute < x < t for _, x in own) for own in times.values() for i, t in own}
    assert spark.read.format("statestore").load(str(tmp_path / "cp")).count() <= monitors.GATE_GROUPS  # 302 jobs in one slice


def test_earlier_attempts_of_wide_spans():
    """Times too far apart for one line of numbers are counted code by code, with the same result."""
    rng = np.random.default_rng(5)
    codes, times = rng.integers(0, 40, 500), rng.integers(0, 1000, 500)
    near = monitors._earlier(codes, times, slice(100, None), 90)
    far = monitors._earlier(np.append(codes, 0), np.append(times, 2**62), slice(100, 500), 90)
    assert (near == far).all()
    assert near.tolist() == [int(((codes == c) & (times > t - 90) & (times < t)).sum()) for c, t in zip(codes[100:], times[100:])]


def test_security_and_sliding_windows(spark, tmp_path):
    put_json(str(tmp_path / "audit"), "a.json", [
        {"id": "1", "timestamp": "2025-01-01T00:00:00", "event_type": "login_failure", "severity": "info"},
        {"id": "2", "timestamp": "2025-01-01T00:00:01", "event_type": "job_created", "severity": "info"},
        {"id": "3", "timestamp": "2025-01-01T00:00:02", "event_type": "job_created", "severity": "critical"}])
    events = monitors.read_json_stream(spark, str(tmp_path / "audit"), AUDIT)
    assert sorted(r.id for r in drain(monitors.security_stream(events), str(tmp_path / "a")).collect()) == ["1", "3"]

    put_json(str(tmp_path / "attempts"), "a.json", [{"id": str(i), "job_id": "j", "attempted_at": f"2025-01-01T00:00:{10 + i:02d}"} for i in range(4)])
    put_json(str(tmp_path / "attempts"), "b.json", [{"id": "late", "job_id": "j", "attempted_at": "2025-01-01T01:00:00"}])
    stream = spark.readStream.schema(ATTEMPTS).option("maxFilesPerTrigger", 1).json(str(tmp_path / "attempts"))
    windows = drain(monitors.sliding_attempts(stream), str(tmp_path / "w")).collect()
    assert max(r.attempts for r in windows) == 4 and any(r.busy for r in windows)


def test_progress_stream(spark, tmp_path):
    put_json(str(tmp_path / "p"), "a.json", [
        {"job_id": "j", "progress_pct": p, "message": f"m{p}", "timestamp": f"2025-01-01T00:00:{s:02d}"} for s, p in ((1, 10.0), (9, 60.0), (5, 30.0))])
    stream = monitors.progress_stream(monitors.read_json_stream(spark, str(tmp_path / "p"), PROGRESS))
    q = stream.writeStream.format("memory").queryName("progress_now").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.progress_pct, r.message) for r in spark.table("progress_now").collect()] == [(60.0, "m60.0")]
