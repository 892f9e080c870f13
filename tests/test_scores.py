import random

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from locusloom.operators import pgs, ranking, scoring, stats
from locusloom.operators.merge import DEFAULT_RULES, merge_multi_sample, to_long, with_samples
from locusloom.plans import registry
from locusloom.plans.derived import CALL_ORDER, Tables

SCHEMA = "sample_id string, label string, value double"


def scaled(spark, values, label="h", **options):
    df = spark.createDataFrame([(str(i), label, v) for i, v in enumerate(values)], SCHEMA)
    return [r.z for r in pgs.scale_pgs(df, **options).orderBy("sample_id").collect()]


def test_zscores(spark):
    assert [round(z, 4) for z in scaled(spark, [1.0, 2.0, 3.0])] == [-1.2247, 0.0, 1.2247]
    assert scaled(spark, [5.0, 5.0, 5.0]) == [0.0, 0.0, 0.0]
    assert scaled(spark, [0.1 + 0.2, 0.3, 0.3]) == [0.0, 0.0, 0.0]
    assert scaled(spark, [42.0]) == [0.0]
    assert scaled(spark, [1.0, 2.0, 3.0], ddof=1) == [-1.0, 0.0, 1.0]


def test_labels_are_independent(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 3.0), ("a", "y", 100.0), ("b", "y", 300.0)], SCHEMA)
    assert sorted((r.label, r.z) for r in pgs.scale_pgs(df).collect()) == [("x", -1.0), ("x", 1.0), ("y", -1.0), ("y", 1.0)]
    row = pgs.pgs_stats(df).filter("label = 'x'").first()
    assert (row.n, row.mean, row.sd, row.min, row.max) == (2, 2.0, 1.0, 1.0, 3.0)
    assert pgs.trait_count(df).first().traits == 2


def test_scaled_mean_and_sd(spark, sf_dir):
    z = pgs.scale_pgs(Tables(spark, sf_dir).pgs()).selectExpr("label", "z AS value", "sample_id")
    for row in pgs.pgs_stats(z).collect():
        assert abs(row.mean) < 1e-9 and abs(row.sd - 1) < 1e-9


@pytest.fixture(scope="module")
def skewed():
    rng = random.Random(3)
    hot = [("hot", 1.0)] * 300 + [("hot", rng.random()) for _ in range(500)]
    return hot + [("cold", float(rng.randrange(10))) for _ in range(90)] + [("one", 4.0)] + [("cold", None)] * 5


def test_ranks_and_quantiles_against_pandas(spark, skewed):
    df = spark.createDataFrame([(g, v, i) for i, (g, v) in enumerate(skewed)], "g string, v double, i int")
    pdf = pd.DataFrame([(g, v, i) for i, (g, v) in enumerate(skewed)], columns=["g", "v", "i"])
    got = {r.i: r.percentile for r in ranking.percent_rank(df, ["g"], "v").collect()}
    clean = pdf.dropna()
    for g, part in clean.groupby("g"):
        ranks = part["v"].rank(method="min") - 1
        expected = ranks * 100 / (len(part) - 1) if len(part) > 1 else ranks * 0.0
        for i, e in zip(part["i"], expected):
            assert abs(got[i] - e) < 1e-9
    assert len(got) == len(skewed) and all(got[i] is None for i in pdf[pdf["v"].isna()]["i"])
    rows = ranking.quantiles(df, ["g"], "v", {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}).collect()
    for r in rows:
        part = clean[clean["g"] == r.g]["v"]
        assert np.allclose([r.a, r.b, r.c, r.d, r.e], part.quantile([0, 0.25, 0.5, 0.9, 1.0]))


def merged_frame(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t, merge_multi_sample(t.panel(), t.calls(), t.imputed(), DEFAULT_RULES, CALL_ORDER, CALL_ORDER)


def test_weighted_scores_by_hand(spark, sf_dir):
    t, merged = merged_frame(spark, sf_dir)
    sites = {(r.chromosome, r.position): r for r in with_samples(merged).collect()}
    observed = {(r.chromosome, r.position) for r in merged.filter("user_observed").collect()}
    expected = {}
    for w in t.weights().collect():
        site = sites.get((w.chromosome, w.position))
        if site is None:
            continue
        for s in site.samples:
            if s.sample_id == "samp51" and (w.chromosome, w.position) not in observed:
                continue  # the person's value is unknown here, not 0|0
            d = s.dosage if w.effect_allele == site.alt_allele else 2 - s.dosage
            old = expected.get((w.trait, s.sample_id), (0.0, 0))
            expected[w.trait, s.sample_id] = (old[0] + d * w.weight, old[1] + 1)
    got = {(r.trait, r.sample_id): (r.raw_score, r.snp_count) for r in scoring.raw_scores(merged, t.weights()).collect()}
    assert got.keys() == expected.keys()
    assert all(abs(got[k][0] - expected[k][0]) < 1e-9 and got[k][1] == expected[k][1] for k in got)


def test_results_and_coverage(spark, sf_dir):
    t, merged = merged_frame(spark, sf_dir)
    rows = scoring.pgs_results(merged, t.weights(), 0.4).collect()
    assert rows and all(0.4 <= r.coverage <= 1 and 0 <= r.percentile <= 100 for r in rows)


def test_ancestry_matches_a_plain_decomposition(spark, sf_dir):
    _, merged = merged_frame(spark, sf_dir)
    matrix = np.array([[s.dosage for s in r.samples] for r in with_samples(merged).collect()]).T
    matrix = matrix - matrix.mean(axis=0)
    u, s, _ = np.linalg.svd(matrix, full_matrices=False)
    rows = {r.sample_id: (r.pc1, r.pc2) for r in scoring.ancestry_components(merged).collect()}
    got = np.array([rows[f"samp{i}"] for i in range(1, 52)])
    assert np.allclose(np.abs(got), np.abs(u[:, :2] * s[:2]), atol=1e-6)


def test_pivots_hold_every_sample(spark, sf_dir):
    from locusloom.plans import catalog

    samples = [f"samp{i}" for i in range(1, 52)]
    wide = catalog.QUERIES["pivot_all_samples"](spark, sf_dir)
    assert wide.columns[4:] == samples and wide.filter(" OR ".join(f"{s} IS NULL" for s in samples)).count() == 0
    scores = catalog.QUERIES["pgs_pivot_all_samples"](spark, sf_dir)
    assert scores.columns == ["label", *samples]
    cells = sum(x is not None for r in scores.collect() for x in r[1:])
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    assert cells == customers.selectExpr("c_mktsegment", "c_custkey % 51").distinct().count()


def test_folding_a_rows_samples_equals_the_long_table(spark, sf_dir):
    """Also where several panel rows share a site."""
    merged = registry.merged(Tables(spark, sf_dir))
    rows = merged.unionByName(merged.filter("position % 3 = 0").withColumn("user_dosage", F.col("user_dosage") / 2))
    long = to_long(rows)
    for ours, theirs in (
        (stats.mean_dosage_of_rows(rows), stats.mean_dosage(long)), (stats.panel_frequency_of_rows(rows), stats.panel_frequency(long)),
        (stats.genotype_distribution_of_rows(rows, ["chromosome", "position"]), stats.genotype_distribution(long, ["chromosome", "position"])),
        (stats.pivot_samples_of_rows(rows, ["samp1", "samp50", "samp51", "samp52"]), stats.pivot_samples(long, ["samp1", "samp50", "samp51", "samp52"])),
        (stats.dataset_profile_of_rows(rows), stats.dataset_profile(long)),
    ):
        columns = sorted(theirs.columns)
        near = [F.round(c, 9).alias(c) if dict(theirs.dtypes)[c] == "double" else F.col(c) for c in columns]
        a, b = ours.select(*near), theirs.select(*near)
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
        assert "Generate explode(sample" not in ours._jdf.queryExecution().optimizedPlan().toString()


def test_ranks_do_not_depend_on_the_ranges(spark, monkeypatch):
    rng = random.Random(9)
    rows = [("s", rng.choice("ab"), rng.choice([0.5, round(rng.random(), 3), None])) for _ in range(2000)]
    df = spark.createDataFrame(rows, SCHEMA)
    one = ranking.cumulative_counts(df, ["label"], "value").collect()
    monkeypatch.setattr(ranking, "RANGE_VALUES", 50)
    many = ranking.cumulative_counts(df, ["label"], "value")
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, one))
    for label in "ab":
        values = sorted(v for _, x, v in rows if x == label and v is not None)
        assert {(r["value"], r.below, r.n, r.total) for r in one if r.label == label} == {
            (v, sum(w < v for w in values), values.count(v), len(values)) for v in set(values)}


def test_description_reads_its_input_once(spark):
    from locusloom.operators.stats import describe_quality

    values = [(g, v) for g in ("a", None) for v in (1e9, 1e9 + 1, 1e9 + 1, 1e9 + 4, None)] + [("one", 7.0), ("none", None)]
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    schema = "g string, imputation_quality double"
    df = spark.createDataFrame(values, schema).mapInArrow(counted, schema)
    rows = {r.g: r for r in describe_quality(df, ["g"]).collect()}
    assert read.value == len(values)
    assert set(rows) == {"a", None, "one"} and rows["a"][1:] == rows[None][1:]
    sample = np.array([1e9, 1e9 + 1, 1e9 + 1, 1e9 + 4])
    got = rows[None]
    assert got["count"] == 4 and got["min"] == 1e9 and got["max"] == 1e9 + 4 and abs(got.mean - sample.mean()) < 1e-6
    assert abs(got.sd - sample.std(ddof=1)) < 1e-9
    assert [got.q25, got.q50, got.q75] == list(np.quantile(sample, [0.25, 0.5, 0.75]))
    assert rows["one"]["count"] == 1 and rows["one"].sd is None and rows["one"].q50 == 7.0
    assert describe_quality(df.limit(0)).collect() == []
    assert describe_quality(spark.createDataFrame(values, schema)).first()["count"] == 9
