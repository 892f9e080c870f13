import pytest
from pyspark.sql import functions as F

from locusloom.operators import merge as M
from locusloom.operators.dedup import best_quality, last_wins
from locusloom.operators.panel_store import merge_stored, store_panel
from locusloom.plans.derived import CALL_ORDER, Tables

PANEL = "chromosome int, position bigint, rsid string, ref_allele string, alt_allele string, allele_freq double, minor_allele_freq double, imputation_quality double, is_typed boolean, sample_genotypes array<string>"
CALLS = "rsid string, chromosome string, position bigint, genotype string, file_path string, split_start bigint, row_id bigint"
IMPUTED = "rsid string, chromosome int, position bigint, ref_allele string, alt_allele string, dosage double, imputation_quality double, file_path string, split_start bigint, row_id bigint"


def panel_rows(spark, sites):
    rows = [(c, p, rsid, r, a, 0.1, 0.1, q, q is None, ["0|1"] * 49 + ["1|2"]) for c, p, rsid, r, a, q in sites]
    return spark.createDataFrame(rows, PANEL)


def call_rows(spark, rows):
    return spark.createDataFrame([(f"c{i}", c, p, g, "f", 0, i) for i, (c, p, g) in enumerate(rows)], CALLS)


def imputed_rows(spark, rows):
    return spark.createDataFrame([(f"i{i}", c, p, r, a, d, q, "f", 0, i) for i, (c, p, r, a, d, q) in enumerate(rows)], IMPUTED)


def users(df):
    return {r.position: (r.user_genotype, r.user_dosage, r.user_source, r.user_quality, r.user_observed) for r in df.collect()}


@pytest.fixture(scope="module")
def inputs(spark):
    sites = [(1, p, f"rs{p}" if p != 6 else None, "A", "G", 0.95) for p in range(1, 9)] + [(1, 9, "rs9", "A", "G", 0.89), (1, 10, "rs10", "A", "G", None)]
    calls = [("1", 1, "AG"), ("1", 2, "GG"), ("1", 3, "--"), ("1", 4, "CC"), ("1", 5, "GA"), ("1", 99, "AG"), ("X", 7, "AG")]
    imputed = [(1, 2, "A", "G", 0.4, 0.5), (1, 3, "A", "G", 1.3, 0.2), (1, 4, "A", "G", 1.6, None), (1, 6, "A", "T", 2.0, 0.9), (1, 7, "A", "G", 0.3, 0.3), (1, 5, "A", "G", 0.1, 0.4)]
    return panel_rows(spark, sites), call_rows(spark, calls), imputed_rows(spark, imputed)


def test_default_rules(inputs):
    merged = M.merge_multi_sample(*inputs)
    assert users(merged) == {
        1: ("0|1", 1.0, "Genotyped", None, True), 2: ("1|1", 2.0, "Genotyped", None, True),
        3: ("0|1", 1.3, "ImputedLowQual", 0.2, True), 4: ("1|1", 1.6, "Imputed", None, True),
        5: ("0|1", 1.0, "Genotyped", None, True), 6: ("0|0", 0.0, "Imputed", 0.95, False),
        7: ("0|0", 0.3, "Imputed", 0.3, True), 8: ("0|0", 0.0, "Imputed", 0.95, False), 10: ("0|0", 0.0, "Imputed", None, False)}
    assert {r.position: r.rsid for r in merged.collect()}[6] == "1:6"


def test_worker_rules_match_only_ref_then_alt(inputs):
    got = users(M.merge_multi_sample(*inputs, M.WORKER_RULES))
    assert got[1] == ("0|1", 1.0, "Genotyped", None, True)
    assert got[2] == ("0|1", 0.4, "Imputed", 0.5, True)
    assert got[3] == ("1|1", 1.3, "ImputedLowQual", 0.2, True)
    assert got[5] == ("0|0", 0.1, "Imputed", 0.4, True)
    assert got[7] == ("0|1", 0.3, "Imputed", 0.3, True)


def test_library_rules(inputs):
    merged = M.merge_multi_sample(*inputs, M.LIBRARY_RULES)
    got = users(merged)
    assert got[1] == ("./.", 0.0, "ImputedLowQual", None, False)
    assert got[2] == ("GG", 2.0, "Genotyped", 0.5, True)
    assert got[3] == ("0|1", 1.3, "ImputedLowQual", 0.2, True)
    assert got[5] == ("GA", 1.0, "Genotyped", 0.4, True)
    assert {r.position: r.rsid for r in merged.collect()}[6] == "chr1:6"


def test_flip_option(spark):
    panel, calls = panel_rows(spark, [(1, 1, "r", "A", "G", None)]), call_rows(spark, [("1", 1, "TC")])
    none = spark.createDataFrame([], IMPUTED)
    assert users(M.merge_multi_sample(panel, calls, none))[1][2] == "Imputed"
    assert users(M.merge_multi_sample(panel, calls, none, M.DEFAULT_RULES.with_(strand_flip=True)))[1][1:3] == (1.0, "Genotyped")


def test_last_line_wins(spark):
    panel = panel_rows(spark, [(1, 1, "r", "A", "G", None), (1, 2, "s", "A", "G", None)])
    calls = call_rows(spark, [("1", 1, "AA"), ("1", 1, "GG"), ("1", 1, "AG")])
    imputed = imputed_rows(spark, [(1, 2, "A", "G", 0.1, 0.9), (1, 2, "A", "G", 1.9, 0.9)])
    got = users(M.merge_multi_sample(panel, calls, imputed))
    assert got[1][1] == 1.0 and got[2][1] == 1.9


def test_hot_keys_keep_whole_results(spark):
    """A third of all rows on one key, on either side."""
    panel = panel_rows(spark, [(1, p, f"r{p}", "A", "G", None) for p in range(200)] + [(1, 7, "hot", "A", "G", None)] * 100)
    calls = call_rows(spark, [("1", p, "AG") for p in range(200)] + [("1", 7, "GG")] * 100)
    merged = M.merge_multi_sample(panel, calls, spark.createDataFrame([], IMPUTED))
    assert merged.count() == 300
    assert merged.filter("position = 7 AND user_dosage = 2.0").count() == 101


@pytest.mark.parametrize("rules", [M.DEFAULT_RULES, M.WORKER_RULES])
def test_skewed_panel_partitions_are_split(spark, tmp_path, rules):
    panel_rows(spark, [(1, p, None, "A", "G", None) for p in range(400)]).union(
        panel_rows(spark, [(1, 7, "hot", "A", "G", None)] * 8).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(500)))).drop("n")
    ).repartition(8).write.parquet(str(tmp_path / "panel"))
    panel = spark.read.parquet(str(tmp_path / "panel"))
    calls = call_rows(spark, [("1", p, "AG") for p in range(400)])
    options = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10000",
        "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k, None) for k in options}
    for k, v in options.items():
        spark.conf.set(k, v)
    try:
        merged = M.merge_multi_sample(panel, calls, spark.createDataFrame([], IMPUTED), rules)
        rows = merged.select("position", "user_dosage", "sample_genotypes").collect()
        assert len(rows) == 4400 and all(r.user_dosage == 1.0 for r in rows)
        assert _skewed(merged)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _skewed(df):
    """Whether the plan that ran has a skewed join."""
    rows = df.select("position", "user_dosage", "sample_genotypes")
    execution = rows._jdf.queryExecution()
    execution.executedPlan().execute().count()
    return "skew=true" in execution.executedPlan().toString()


def test_rule_names_are_checked():
    for bad in ({"call_match": "x"}, {"missing": "x"}, {"key": "x"}, {"key": "rsid", "call_match": "letters"}):
        with pytest.raises(ValueError):
            M.MergeRules(**bad)


def test_forms(inputs):
    merged = M.merge_multi_sample(*inputs)
    long, wide = M.to_long(merged), M.with_samples(merged)
    assert long.count() == 51 * merged.count()
    exploded = wide.select("rsid", "chromosome", "position", "ref_allele", "alt_allele", "allele_freq", "minor_allele_freq",
                           F.col("is_typed").cast("int").alias("is_typed"), F.explode("samples").alias("s")).select(
        *long.columns[:8], "s.*")
    assert exploded.exceptAll(long).count() == 0 and long.exceptAll(exploded).count() == 0
    cell = long.filter("position = 1 AND sample_id = 'samp50'").first()
    assert (cell.genotype, cell.dosage, cell.source) == ("1|2", 3.0, "Imputed")


def test_single_sample(inputs):
    _, calls, imputed = inputs
    rows = {r.position: (r.dosage, r.source, r.imputation_quality) for r in M.merge_single_sample(imputed, calls, 0.5).collect()}
    assert rows == {2: (2.0, "Genotyped", None), 4: (1.6, "Imputed", None), 5: (1.0, "Genotyped", None), 6: (2.0, "Imputed", 0.9)}
    counters = M.single_sample_counters(M.single_sample_candidates(imputed, calls, 0.5)).first()
    assert (counters.genotyped, counters.imputed, counters.filtered, counters.total) == (2, 2, 2, 4)


def test_counters(inputs):
    row = M.merge_counters(inputs[0], M.merge_multi_sample(*inputs)).first()
    assert (row.genotyped, row.imputed, row.absent, row.filtered, row.total) == (3, 3, 3, 1, 9)


def test_dedup_helpers(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, o int, v string")
    assert sorted(map(tuple, last_wins(df, ["k"], ["o"]).collect())) == [(1, "b"), (2, "c")]
    df = spark.createDataFrame([("r", None, 1), ("r", 0.5, 3), ("r", 0.5, 2), ("s", None, 4)], "rsid string, q double, p int")
    assert sorted(map(tuple, best_quality(df, ["rsid"], "q", ["p"]).collect())) == [("r", 0.5, 2), ("s", None, 4)]


def test_wide_rows_shuffle_once_without_broadcast(spark, sf_dir):
    """Panel rows are partitioned by place once for both user joins."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        t = Tables(spark, sf_dir)
        merged = M.merge_multi_sample(t.panel(), t.calls(), t.imputed(), M.DEFAULT_RULES, CALL_ORDER, CALL_ORDER)
        plan = merged._jdf.queryExecution().executedPlan().toString()
        joins = plan.count("SortMergeJoin")
        by_place = [line for line in plan.splitlines() if "Exchange hashpartitioning(chromosome" in line]
        # The panel once; calls and imputed rows for their aggregate and, short by then, for the join.
        assert joins == 2 and len(by_place) == 5
        assert sum("sample_genotypes" in line for line in plan.splitlines() if "Exchange" in line) <= 1
        shuffled = merged.groupBy("user_source").count().collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(64 * 1024 * 1024))
    t = Tables(spark, sf_dir)
    again = M.merge_multi_sample(t.panel(), t.calls(), t.imputed(), M.DEFAULT_RULES, CALL_ORDER, CALL_ORDER)
    assert sorted(shuffled) == sorted(again.groupBy("user_source").count().collect())


@pytest.mark.parametrize("rules", [M.DEFAULT_RULES, M.WORKER_RULES, M.LIBRARY_RULES])
def test_stored_panel_is_not_shuffled(spark, sf_dir, rules):
    t = Tables(spark, sf_dir)
    hot = panel_rows(spark, [(1, 7, f"hot{i}", "A", "G", None) for i in range(300)])
    panel = t.panel().unionByName(hot.select(*[c for c in hot.columns if c in t.panel().columns]), allowMissingColumns=True)
    calls = t.calls().unionByName(call_rows(spark, [("1", 7, "AG")]).drop("file_path", "split_start", "row_id"), allowMissingColumns=True)
    store = store_panel(panel, hot=50)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = merge_stored(store, calls, t.imputed(), rules, CALL_ORDER, CALL_ORDER)
        plan = got._jdf.queryExecution().executedPlan().toString()
        exchanged = [line for line in plan.splitlines() if "Exchange" in line and "sample_genotypes" in line]
        assert "Bucketed: true" in plan and not exchanged
        above = plan[:plan.index("Bucketed: true")].rsplit("SortMergeJoin", 1)[1]  # from the first join down to the panel's scan
        assert "Exchange" not in above
        expected = M.merge_multi_sample(panel, calls, t.imputed(), rules, CALL_ORDER, CALL_ORDER)
        assert got.exceptAll(expected).count() == 0 and expected.exceptAll(got).count() == 0
        parts = spark.table(store.table).filter("chromosome = 1 AND position = 7").groupBy("part").count().collect()
        assert len(parts) == 6 and max(r["count"] for r in parts) < 100
        assert store.panel().exceptAll(panel).count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(64 * 1024 * 1024))
        store.drop()


def test_dots_are_no_identifiers(spark):
    panel = panel_rows(spark, [(1, 1, ".", "A", "G", None), (1, 2, "", "A", "G", None), (1, 3, None, "A", "G", None), (1, 4, "rs4", "A", "G", None)])
    calls = spark.createDataFrame([(i, "1", 90, "GG", "f", 0, n) for n, i in enumerate([".", "", None, "rs4"])], CALLS)
    got = users(M.merge_multi_sample(panel, calls, spark.createDataFrame([], IMPUTED), M.DEFAULT_RULES.with_(key="rsid")))
    assert [got[p][2] for p in (1, 2, 3, 4)] == ["Imputed"] * 3 + ["Genotyped"]
