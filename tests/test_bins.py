"""Tables in bins of position, and the feed that keeps a merge in them."""

import os
import random

import pytest
from pyspark.sql import functions as F

from locusloom.operators.merge import DEFAULT_RULES, WORKER_RULES, merge_multi_sample
from locusloom.schemas import IMPUTED_ROWS, SITE_KEY
from locusloom.sinks.bins import BinTable
from locusloom.sources.vcf import VcfErrorBudgetExceeded
from locusloom.streaming.chromosomes import ChromosomeFeed
from tests.test_merge import CALLS, panel_rows

ROWS = "rsid string, chromosome int, position bigint, ref_allele string, alt_allele string, dosage double, imputation_quality double, n bigint"


def rows(spark, items):
    return spark.createDataFrame([("r", c, p, "A", a, d, 0.9, n) for n, (c, p, a, d) in enumerate(items)], ROWS)


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def test_upserts_equal_a_dictionary(spark, tmp_path):
    rng, table, want = random.Random(1), BinTable(spark, str(tmp_path / "t"), IMPUTED_ROWS, SITE_KEY, width=100), {}
    for version in range(4):
        items = [(rng.randint(1, 3), rng.randint(1, 600), rng.choice("CGT"), round(rng.random() * 2, 3)) for _ in range(150)]
        items += [(1, 5, "C", float(k % 3)) for k in range(60)]  # one key many times
        got, bins = table.upsert(rows(spark, items), ["n"])
        want |= {(c, p, a): d for c, p, a, d in items}
        assert got == version and {(r.chromosome, r.bin) for r in bins.collect()} == {(c, p // 100) for c, p, _, _ in items}
        assert {(r.chromosome, r.position, r.alt_allele): r.dosage for r in table.read().collect()} == want
        assert table.read().count() == len(want)


def test_a_change_reads_and_writes_its_bins_only(spark, tmp_path):
    table = BinTable(spark, str(tmp_path / "t"), IMPUTED_ROWS, SITE_KEY, width=1000)
    table.upsert(rows(spark, [(c, p, "G", 0.5) for c in range(1, 5) for p in range(1, 3000)]), ["n"])
    written = []
    for version in range(1, 4):
        table.upsert(rows(spark, [(2, 1500 + version, "G", 1.0)]), ["n"])
        names = sorted(n for n in os.listdir(tmp_path / f"t/data/version={version}/chromosome=2") if n.startswith("bin="))
        assert os.listdir(tmp_path / f"t/data/version={version}").count("chromosome=1") == 0 and names == ["bin=1"]
        written.append(size(tmp_path / f"t/data/version={version}"))
    assert max(written) < 1.1 * min(written) and written[0] < size(tmp_path / "t/data/version=0") / 5
    part = table.read(bins=spark.createDataFrame([(2, 1)], "chromosome int, bin bigint"))
    assert part.count() == 1000 and all("bin=1" in f for f in part.inputFiles())


def test_readers_keep_to_the_last_whole_version(spark, tmp_path):
    table = BinTable(spark, str(tmp_path / "t"), IMPUTED_ROWS, SITE_KEY, width=100)
    assert table.read().count() == 0 and table.version() is None
    table.upsert(rows(spark, [(1, 1, "G", 0.1), (1, 150, "G", 0.2)]), ["n"])
    held = table.read()
    # A writer that was lost before its manifest: its rows are not seen, and written over when it comes again.
    rows(spark, [(1, 1, "G", 9.0)]).withColumn("bin", F.lit(0)).drop("n").write.partitionBy("chromosome", "bin").parquet(str(tmp_path / "t/data/version=1"))
    assert sorted(r.dosage for r in table.read().collect()) == [0.1, 0.2]
    for _ in range(2):  # the second time it is a replay under the same number
        assert table.upsert(rows(spark, [(1, 1, "G", 0.5)]), ["n"], version=1)[0] == 1
        assert sorted(r.dosage for r in table.read().collect()) == [0.2, 0.5]
    assert sorted(r.dosage for r in held.collect()) == [0.1, 0.2] and sorted(r.dosage for r in table.read(0).collect()) == [0.1, 0.2]
    assert table.upsert(rows(spark, []), ["n"])[0] == 1
    table.replace(rows(spark, []).drop("n"), spark.createDataFrame([(1, 0)], "chromosome int, bin bigint"))
    assert [r.dosage for r in table.read().collect()] == [0.2]
    table.forget(1)
    assert table.versions() == [2] and [r.dosage for r in table.read().collect()] == [0.2]
    assert not os.path.exists(tmp_path / "t/data/version=1")
    with pytest.raises(Exception, match="without chromosome or position"):
        table.upsert(rows(spark, [(None, 1, "G", 0.1)]), ["n"])


def lines(items):
    return "".join(f"{c}\t{p}\t.\tA\tG\t.\tPASS\tR2={q}\tGT:DS\t0|0:{d}\n" for c, p, d, q in items)


@pytest.mark.parametrize("rules", [DEFAULT_RULES, WORKER_RULES])
def test_feed_of_raw_batches_equals_one_merge(spark, tmp_path, rules):
    rng = random.Random(2)
    panel = panel_rows(spark, [(c, p, None, "A", "G", 0.95) for c in (1, 2) for p in range(1, 400, 3)])
    calls = spark.createDataFrame([("c", "1", p, rng.choice(["AG", "GG", "--"]), "f", 0, p) for p in range(1, 400, 9)], CALLS)
    feed = ChromosomeFeed(spark, panel, calls, str(tmp_path / "t"), rules, width=50)
    feed.initialise()
    os.makedirs(tmp_path / "in")
    last, written = {}, []
    for n in range(4):
        items = [(rng.choice((1, 2)), rng.randint(1, 99), round(rng.random() * 2, 2), 0.9) for _ in range(200)]  # unsorted, repeated
        (tmp_path / f"in/{n}.vcf").write_text("##x\n" + lines(items))
        feed.start(str(tmp_path / "in"), str(tmp_path / "cp")).awaitTermination()
        last |= {(c, p): d for c, p, d, _ in items}
        written.append(spark.read.parquet(str(tmp_path / f"t/merged/data/version={n + 1}")).count())
    imputed = spark.createDataFrame([("r", c, p, "A", "G", d, 0.9) for (c, p), d in last.items()], IMPUTED_ROWS)
    expected = merge_multi_sample(panel, calls, imputed, rules, None, [])
    got = feed.merged().select(*expected.columns)
    assert got.exceptAll(expected).count() == 0 and expected.exceptAll(got).count() == 0
    assert feed.state.read().count() == len(last) and feed.received().count() == 800
    assert max(written) == min(written) < expected.count() / 2 and feed.missing().count() == 20


def test_feed_enforces_the_budget_of_each_file(spark, tmp_path):
    panel = panel_rows(spark, [(1, p, None, "A", "G", 0.95) for p in range(1, 20)])
    none = spark.createDataFrame([], CALLS)
    bad = lines([(1, 1, 5.0, 0.9)] * 3)
    for mode in ("fail", "skip"):
        feed = ChromosomeFeed(spark, panel, none, str(tmp_path / mode), max_errors=2, on_excess=mode)
        feed.initialise()
        os.makedirs(tmp_path / f"{mode}-in")
        (tmp_path / f"{mode}-in/a.vcf").write_text(lines([(1, 2, 1.5, 0.9), (1, 2, 9.0, 0.9)]))
        (tmp_path / f"{mode}-in/b.vcf").write_text(bad + lines([(1, 3, 1.5, 0.9)]))
        batch = spark.read.text(str(tmp_path / f"{mode}-in")).select(
            "value", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("split_start"))
        if mode == "fail":
            with pytest.raises(VcfErrorBudgetExceeded):
                feed.append(batch, 0)
            assert feed.received().count() == 0 and feed.state.version() is None and feed.refused().count() == 0
        else:
            feed.append(batch, 0)
            assert [r.position for r in feed.state.read().collect()] == [2] and feed.rejects().count() == 1
            assert [(r.file_path.rsplit("/", 1)[1], r.error_rows) for r in feed.refused().collect()] == [("b.vcf", 3)]
    with pytest.raises(ValueError):
        ChromosomeFeed(spark, panel, none, "x", on_excess="other")


def test_bins_are_as_wide_as_their_rows_ask_for(spark, tmp_path, monkeypatch):
    """Rows far apart share bins, as many folders as the rows fill; the width is kept by later changes and other objects."""
    monkeypatch.setattr("locusloom.sinks.bins.BIN_ROWS", 100)
    far = [(c, p * 2_000_000, "G", 0.5) for c in (1, 2) for p in range(1, 400)] + [(1, 2**40, "G", 0.5)]
    table = BinTable(spark, str(tmp_path / "t"), IMPUTED_ROWS, SITE_KEY)
    table.upsert(rows(spark, far), ["n"])
    assert table.manifest(0).count() <= 11 and table.read().count() == len(far)
    again = BinTable(spark, str(tmp_path / "t"), IMPUTED_ROWS, SITE_KEY)
    _, bins = again.upsert(rows(spark, [(2, 2_000_000, "G", 1.5), (2, 2_000_001, "G", 1.5)]), ["n"])
    assert again.width == table.width > 100_000_000 and bins.count() == 1
    assert again.read().count() == len(far) + 1 and again.read().filter("dosage = 1.5").count() == 2
    # Repeated under its own number, the first write sets the width anew from its rows.
    first = BinTable(spark, str(tmp_path / "t"), IMPUTED_ROWS, SITE_KEY)
    assert first.upsert(rows(spark, far[:3]), ["n"], version=0)[0] == 0 and first.read(0).count() == 3


def test_a_feed_has_one_width_for_its_tables(spark, tmp_path):
    panel = panel_rows(spark, [(1, p * 3_000_000, None, "A", "G", 0.95) for p in range(1, 200)])
    calls = spark.createDataFrame([("c", "1", 6_000_000, "GG", "f", 0, 0)], CALLS)
    ChromosomeFeed(spark, panel, calls, str(tmp_path / "t")).initialise()
    feed = ChromosomeFeed(spark, panel, calls, str(tmp_path / "t"))  # after a restart
    (tmp_path / "a.vcf").write_text(lines([(1, 3_000_000 * p, 1.5, 0.9) for p in range(1, 100)]))
    feed.append(spark.read.text(str(tmp_path / "a.vcf")).select(
        "value", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("split_start")), 0)
    widths = {t._stored_width(t.version()) for t in (feed.panel_bins, feed.call_bins, feed.state, feed.table)}
    assert widths == {feed.panel_bins.width} and feed.table.manifest(1).count() == 1
    assert feed.merged().count() == 199 and feed.merged().filter("user_dosage = 1.5").count() == 98
