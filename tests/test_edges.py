"""Edges that were wrong once: numbers that are none, odd names, moments in the future, no-calls."""

import datetime

from pyspark.sql import functions as F

from locusloom.functions.genotype import passes_quality
from locusloom.operators import downloads, jobs, scoring
from locusloom.session import configure
from locusloom.sources import pgs


def test_nan_quality_fails(spark):
    df = spark.createDataFrame([(0.95,), (0.5,), (float("nan"),), (None,)], "q double")
    assert [r[0] for r in df.select(passes_quality("q", 0.9)).collect()] == [True, False, False, True]


def test_wide_scores_with_a_dot_in_a_trait(spark):
    df = spark.createDataFrame([("s1", "1.5", "2")], "sample string, `type.2` string, bmi string")
    assert {(r.label, r.value) for r in pgs.wide_scores(df).collect()} == {("type.2", 1.5), ("bmi", 2.0)}


def test_weights_off_the_autosomes(spark, tmp_path):
    path = tmp_path / "w.tsv"
    path.write_text("SNP\tCHR\tBP\tA1\tA2\tweight\nrs1\tchr7\t5\tA\tC\t0.1\nrs2\tX\t6\tA\tC\t0.2\nrs3\t22\t7\tA\tC\t0.3\n")
    assert [r.chromosome for r in pgs.read_pgs_weights(spark, str(path)).orderBy("position").collect()] == [7, None, 22]


def test_later_attempts_do_not_block(spark):
    at = datetime.datetime(2024, 6, 1)
    rows = [(1, at + datetime.timedelta(days=365)), (1, at + datetime.timedelta(days=366)), (1, at + datetime.timedelta(days=367))]
    rows += [(2, at - datetime.timedelta(seconds=s)) for s in (0, 10, 20, 120)]
    attempts = spark.createDataFrame([(j, t, "success") for j, t in rows], "job_id bigint, attempted_at timestamp, attempt_result string")
    got = {r.job_id: r.recent for r in downloads.attempts_per_job(attempts, "2024-06-01 00:00:00").collect()}
    assert got == {1: 0, 2: 3}
    audit = attempts.select(F.col("job_id").alias("id"), F.col("attempted_at").alias("timestamp"))
    assert {r.id for r in jobs.recent_audit(audit, "2024-06-01 00:00:00").collect()} == {2}


def test_no_calls_are_not_scored(spark):
    merged = spark.createDataFrame(
        [("rs1", 1, 10, "A", "C", ["0|1", "./."], "0|0", 0.0, False), ("rs2", 1, 20, "A", "C", ["1|1", "0|1"], "0|1", 1.0, True)],
        "rsid string, chromosome int, position bigint, ref_allele string, alt_allele string, sample_genotypes array<string>, user_genotype string, "
        "user_dosage double, user_observed boolean")
    weights = spark.createDataFrame(
        [("t", "rs1", 1, 10, "A", "C", 1.0), ("t", "rs2", 1, 20, "C", "A", 10.0), ("u", "rs1", 1, 10, "A", "C", 1.0)],
        "trait string, rsid string, chromosome int, position bigint, effect_allele string, other_allele string, weight double")
    got = {(r.trait, r.sample_id): (r.raw_score, r.snp_count) for r in scoring.raw_scores(merged, weights).collect()}
    assert got == {("t", "samp1"): (21.0, 2), ("t", "samp2"): (10.0, 1), ("t", "samp3"): (10.0, 1), ("u", "samp1"): (1.0, 1)}


def test_broadcasts_follow_measured_sizes(spark):
    """Estimates follow compressed bytes, so only Spark's own limit holds for them; an owner's limit is kept."""
    estimated, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    own = spark.newSession()
    own.conf.unset(measured)
    configure(own)
    assert own.conf.get(estimated) == "10485760b" and own.conf.get(measured) == str(64 * 1024 * 1024)
    assert int(own.conf.get("spark.sql.adaptive.coalescePartitions.minPartitionNum")) == 12
    own.conf.unset(measured)
    own.conf.set(estimated, "-1")
    assert configure(own).conf.get(measured) is None
