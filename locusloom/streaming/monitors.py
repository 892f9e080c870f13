"""Streaming views over attempts, audit events and progress messages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from locusloom.operators.downloads import MAX_PER_MINUTE, SLICE_WINDOWS, time_slices
from locusloom.operators.jobs import latest_progress, security_events


def read_json_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Rows of JSON-line files as they arrive."""
    return spark.readStream.schema(schema).json(folder)


def security_stream(audit: DataFrame) -> DataFrame:
    """Security events as they arrive."""
    return security_events(audit)


def progress_stream(progress: DataFrame) -> DataFrame:
    """Newest message per job; write in update or complete mode."""
    return latest_progress(progress)


def sliding_attempts(attempts: DataFrame, lateness: str = "2 minutes", window: str = "1 minute", slide: str = "10 seconds") -> DataFrame:
    """Attempts per job in sliding windows; ``busy`` from the limit on.

    An event-time aggregate with partial sums per map task, so a busy job is no hot spot. It
    decides on window edges; ``exact_gate`` decides per attempt.
    """
    counted = attempts.withWatermark("attempted_at", lateness).groupBy(
        "job_id", F.window("attempted_at", window, slide)).agg(F.count("*").alias("attempts"))
    return counted.select(
        "job_id", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "attempts",
        (F.col("attempts") >= MAX_PER_MINUTE).alias("busy"))


_GATE_OUTPUT = "job_id string, id string, attempted_at timestamp, prior bigint, rate_limited boolean"
_GATE_STATE = "jobs array<string>, codes array<int>, times array<bigint>"
# Fixed value: groups of jobs that share one state of a slice. A checkpoint keeps to it.
GATE_GROUPS = 256


def _earlier(codes: np.ndarray, times: np.ndarray, at: slice, span: int) -> np.ndarray:
    """For the rows ``at``: how many rows of the same code lie in the ``span`` before them."""
    order = np.lexsort((times, codes))
    codes_in, times_in = codes[order], times[order]
    starts = np.searchsorted(codes_in, np.arange(codes.max() + 2))
    # Times as numbers that grow from code to code, each code's range apart from the next by more than the span.
    base = times.min()
    width = int(times.max() - base) + 2 * span + 1
    if (len(starts) + 1) * width < 2**63:
        line = codes_in.astype("int64") * width + (times_in - base)
        own = codes[at].astype("int64") * width + (times[at] - base)
        return np.searchsorted(line, own, "left") - np.searchsorted(line, own - span, "right")
    out = np.empty(len(times[at]), dtype="int64")
    for code in np.unique(codes[at]):
        mine, line = codes[at] == code, times_in[starts[code]:starts[code + 1]]
        out[mine] = np.searchsorted(line, times[at][mine], "left") - np.searchsorted(line, times[at][mine] - span, "right")
    return out


def exact_gate(attempts: DataFrame, seconds: int = 60, limit: int = MAX_PER_MINUTE, lateness: str = "2 minutes", groups: int = GATE_GROUPS) -> DataFrame:
    """Each attempt with the number of earlier ones, seen so far, in the trailing window.

    State is kept per group of jobs and slice of time; an attempt near the end of its slice also goes to
    the next one as context. A busy job is thus spread over its slices, and a slice's state
    goes when the watermark has passed it. Jobs are taken in groups because each call of the step has a
    price of its own, which a job of few attempts does not repay.
    """
    span = seconds * 1_000_000
    length = span * SLICE_WINDOWS

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches), ignore_index=True)
        jobs, held, before = state.get if state.exists else ([], [], [])
        codes, names = pd.factorize(np.concatenate([np.array(jobs, dtype=object), rows["job_id"].to_numpy(dtype=object)]), use_na_sentinel=False)
        codes = np.concatenate([codes[:len(jobs)][np.array(held, dtype="int64")], codes[len(jobs):]])
        times = np.concatenate([np.array(before, dtype="int64"), rows["micros"].to_numpy(dtype="int64")])
        state.update(([None if pd.isna(n) else n for n in names], codes.tolist(), times.tolist()))
        state.setTimeoutTimestamp(max((int(key[1]) + 1) * length // 1000, state.getCurrentWatermarkMs() + 1))
        own = rows["own"].to_numpy(dtype=bool)
        if own.any():
            prior = _earlier(codes, times, slice(len(held), None), span)[own]
            yield rows.loc[own, ["job_id", "id", "attempted_at"]].assign(prior=prior, rate_limited=prior >= limit)

    micros = F.unix_micros("attempted_at")
    rows = attempts.withWatermark("attempted_at", lateness).select(
        F.col("job_id").cast("string").alias("job_id"), F.col("id").cast("string").alias("id"), "attempted_at",
        micros.alias("micros"), F.explode(time_slices(micros, span)).alias("_at"),
    ).select("job_id", "id", "attempted_at", "micros", "_at.slice", "_at.own", F.pmod(F.xxhash64("job_id"), F.lit(groups)).alias("jobs"))
    return rows.groupBy("jobs", "slice").applyInPandasWithState(
        step, _GATE_OUTPUT, _GATE_STATE, "append", GroupStateTimeout.EventTimeTimeout)
