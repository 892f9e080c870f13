"""Zone tables: files opened by regions, counts by the index, pages by cursor."""

import random

from pyspark.sql import functions as F

from locusloom.operators import scoring
from locusloom.plans.derived import Tables
from locusloom.plans.registry import merged
from locusloom.session import staged_path
from locusloom.sinks.zones import ZoneTable

SCHEMA = "chromosome int, position bigint, ref_allele string, value int"


def written(spark, rows, file_rows=50):
    table = ZoneTable(spark, staged_path(spark, "zone test, %20 ä"))
    df = spark.createDataFrame(rows, SCHEMA)
    if rows:
        df = df.repartition(3)
    table.write(df, file_rows=file_rows)
    return table


def some_rows():
    random.seed(4)
    rows = [(c, random.randrange(1, 2000), random.choice("ACGT"), i) for c in (1, 2, 3) for i in range(400)]
    return rows + [(2, 700, "A", 1000 + i) for i in range(300)]  # one place with many equal rows


def opened(df):
    return len(df.inputFiles())


def test_regions_open_the_files_they_meet(spark):
    rows = some_rows()
    table = written(spark, rows)
    everything = table.index().count()
    assert everything >= len(rows) // 50
    region = table.region(3, 100, 200)
    assert opened(region) <= 3 < everything
    assert sorted(map(tuple, region.collect())) == sorted(r for r in rows if r[0] == 3 and 100 <= r[1] <= 200)
    two = table.regions([(1, 5, 90), (1, 50, 120)])
    assert sorted(map(tuple, two.collect())) == sorted(r for r in rows if r[0] == 1 and 5 <= r[1] <= 120)
    assert table.regions([]).count() == 0 and table.region(9, 1, 10).count() == 0


def test_counts_come_from_the_index(spark):
    rows = some_rows()
    table = written(spark, rows)
    for c, s, e in [(1, 1, 2000), (2, 300, 1500), (2, 700, 700), (3, 1999, 5000), (7, 1, 5), (2, 900, 300)]:
        assert table.region_count(c, s, e) == sum(r[0] == c and s <= r[1] <= e for r in rows), (c, s, e)
    files = table.files([(2, 300, 1500)])
    inside = [f for f in files if (2 << 40) + 300 <= f.first_place and f.last_place <= (2 << 40) + 1500]
    assert len(files) - len(inside) <= 2


def test_pages_hold_every_row_once(spark):
    rows = some_rows()
    table = written(spark, rows)
    got, cursor, pages = [], None, 0
    while True:
        page, cursor = table.page(2, 300, 1500, size=90, after=cursor, keep=F.col("value") % 2 == 0)
        part = page.collect()
        assert opened(page) <= 8
        got += map(tuple, part)
        pages += 1
        if cursor is None:
            break
        assert len(part) == 90
    expected = [r for r in rows if r[0] == 2 and 300 <= r[1] <= 1500 and r[3] % 2 == 0]
    assert sorted(got) == sorted(expected) and pages == -(-len(expected) // 90)
    assert [r[:3] for r in got] == sorted(r[:3] for r in expected)


def test_a_selective_page_goes_on_to_the_end(spark):
    rows = some_rows()
    table = written(spark, rows)
    page, cursor = table.page(2, 1, 3000, size=5, keep=F.col("value") == 1299)
    assert [r.value for r in page.collect()] == [1299] and cursor is None


def test_rows_without_a_place_and_empty_tables(spark):
    rows = [(1, 5, "A", 1), (None, 7, "C", 2), (1, None, "G", 3), (1, 6, None, 4)]
    table = written(spark, rows, file_rows=10)
    assert sorted(r.value for r in table.region(1, 1, 10).collect()) == [1, 4]
    assert table.region_count(1, 1, 10) == 2
    assert sorted(r.value for r in table.page(1, 1, 10)[0].collect()) == [1, 4]
    empty = written(spark, [])
    page, cursor = empty.page(1, 1, 10)
    assert page.count() == 0 and cursor is None and empty.region_count(1, 1, 10) == 0


def test_distances_of_all_components_are_those_of_the_dosages(spark, sf_dir):
    rows = merged(Tables(spark, sf_dir))
    distances = scoring.ancestry_distances(scoring.ancestry_components(rows, 51))
    assert distances.count() == 51 * 50
    assert scoring.ancestry_components(rows.limit(0)).collect() == []
    # A missing dosage counts as its variant's mean and makes no component NaN.
    gaps = rows.withColumn("sample_genotypes", F.transform("sample_genotypes", lambda g, i: F.when(i == 3, "./.").otherwise(g)))
    assert scoring.ancestry_components(gaps).filter("isnan(pc1) OR pc1 IS NULL").count() == 0


def test_a_hot_place_is_written_by_several_tasks(spark, tmp_path):
    """Nine tenths of the rows share place, alleles and identifier; parts stay even and in order."""
    from locusloom.sinks import tables, vcf

    df = spark.range(4000).select(
        F.lit(1).alias("chromosome"), F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(F.lit(500)).alias("position"),
        F.lit("A").alias("ref_allele"), F.lit("G").alias("alt_allele"), F.lit("rs1").alias("rsid"), "id")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = tables.by_place(df).withColumn("part", F.spark_partition_id()).collect()
        vcf.write_merged_vcf(
            df, str(tmp_path / "v"), ["##head", "#CHROM"], lambda r: r.withColumn("value", F.concat_ws("\t", "chromosome", "position", "id")), "none")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    sizes = [sum(r.part == n for r in parts) for n in {r.part for r in parts}]
    assert len(sizes) >= 4 and max(sizes) < 2000 and len({r.id for r in parts}) == 4000
    assert len({r.part for r in parts if r.position == 500}) > 1
    in_order = [(r.part, r.position) for r in parts]
    assert [p for _, p in sorted(in_order)] == sorted(p for _, p in in_order)
    texts = [f.read_text().splitlines() for f in sorted((tmp_path / "v").glob("part-*"))]
    lines = [line for t in texts for line in t]
    assert max(map(len, texts)) < 2000 and lines[:2] == ["##head", "#CHROM"] and len(lines) == 4002
    positions = [int(line.split("\t")[1]) for line in lines[2:]]
    assert positions == sorted(positions)


def test_an_owner_removes_its_staged_tables(spark):
    import pytest

    from locusloom.session import Staging, stage

    outside = stage(spark.range(3), "kept")
    with Staging(spark) as outer:
        first = stage(spark.range(5), "mine")
        with Staging(spark) as inner:
            second = stage(spark.range(7), "nested")
    assert first.count() == 5 and second.count() == 7
    assert inner.drop() and first.count() == 5
    assert outer.drop() and not outer.drop() and outside.count() == 3
    with pytest.raises(ZeroDivisionError), Staging(spark) as failed:
        stage(spark.range(2), "lost")
        raise ZeroDivisionError
    assert not failed.drop()
    assert "owner" not in stage(spark.range(1), "free").inputFiles()[0]
