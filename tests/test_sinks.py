import glob
import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from locusloom.operators.merge import DEFAULT_RULES, merge_multi_sample, merge_single_sample, to_long, with_samples
from locusloom.operators.pgs import scale_pgs
from locusloom.operators.stats import run_statistics
from locusloom.plans.catalog import QUERIES
from locusloom.plans.derived import CALL_ORDER, Tables
from locusloom.schemas import SITE_KEY
from locusloom.session import stage
from locusloom.sinks import ranges, tables, vcf
from locusloom.sources.files import output_register
from locusloom.sources.vcf import scan_vcf


@pytest.fixture(scope="module")
def merged(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return merge_multi_sample(t.panel(), t.calls(), t.imputed(), DEFAULT_RULES, CALL_ORDER, CALL_ORDER)


def joined_text(path):
    """Part files in name order, joined as bytes, then unzipped as one stream."""
    data = b"".join(open(p, "rb").read() for p in sorted(glob.glob(os.path.join(path, "part-*"))))
    return gzip.decompress(data).decode("utf-8").splitlines()


def test_long_parquet(spark, merged, tmp_path):
    path = str(tmp_path / "long")
    tables.write_long_parquet(merged, path)
    assert sorted(os.path.basename(p) for p in glob.glob(path + "/chromosome=*"))[:2] == ["chromosome=1", "chromosome=10"]
    back = tables.read_long_parquet(spark, path)
    assert back.columns == to_long(merged).columns
    assert back.exceptAll(to_long(merged)).count() == 0 and back.count() == 51 * merged.count()
    some = tables.read_long_parquet(spark, path, [3], ["position", "dosage"])
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "sample_id" not in plan
    flat = str(tmp_path / "flat")
    tables.write_long_parquet(merged, flat, partitioned=False)
    assert spark.read.parquet(flat).count() == back.count()


def test_merged_vcf_is_one_ordered_file(spark, merged, tmp_path):
    path = str(tmp_path / "vcf")
    header = vcf.multi_sample_header("20250101")
    vcf.write_merged_vcf(merged, path, header)
    lines = joined_text(path)
    assert lines[:len(header)] == header and lines[0] == "##fileformat=VCFv4.3"
    body = [x.split("\t") for x in lines[len(header):]]
    assert len(body) == merged.count() and all(len(x) == 9 + 51 for x in body)
    places = [(int(x[0][3:]), int(x[1])) for x in body]
    assert places == sorted(places)
    # The file reads back as imputed rows of its last sample.
    back = scan_vcf(spark, path)
    rows = back.join(merged, ["chromosome", "position", "ref_allele", "alt_allele"])
    assert rows.count() == merged.count() and rows.filter(F.abs(F.col("dosage") - F.col("user_dosage")) > 0.0005).count() == 0


def test_vcf_per_chromosome(merged, tmp_path):
    path = str(tmp_path / "vcf")
    header = vcf.multi_sample_header("20250101", "user")
    vcf.write_vcf_per_chromosome(merged, path, header)
    assert len(glob.glob(path + "/chromosome=*")) == 22
    for chromosome in (1, 22):
        lines = joined_text(f"{path}/chromosome={chromosome}")
        assert lines[:len(header)] == header and lines[len(header) - 1].endswith("\tuser")
        assert {x.split("\t")[0] for x in lines[len(header):]} == {f"chr{chromosome}"}


def test_single_sample_outputs(spark, sf_dir, tmp_path):
    t = Tables(spark, sf_dir)
    single = merge_single_sample(t.imputed(), t.calls(), 0.9, CALL_ORDER)
    tables.write_single_parquet(single, str(tmp_path / "single"))
    back = spark.read.parquet(str(tmp_path / "single")).select(*single.columns)
    assert back.count() == single.count() and "chromosome" in back.columns
    header = vcf.single_sample_header("20250101")
    vcf.write_merged_vcf(single, str(tmp_path / "vcf"), header, vcf.single_sample_lines)
    lines = joined_text(str(tmp_path / "vcf"))
    assert lines[:len(header)] == header and all("SRC=" in x for x in lines[len(header):])


def test_relational_tables(spark, sf_dir, merged, tmp_path):
    metadata = tables.run_metadata(run_statistics(merged), "j", "u", "2025-01-01")
    scored = scale_pgs(Tables(spark, sf_dir).pgs())
    frames = tables.relational_frames(merged.unionAll(merged), metadata, scored)
    tables.write_tables(frames, str(tmp_path))
    variants = spark.read.parquet(str(tmp_path / "variants"))
    assert variants.count() == 51 * merged.count()
    assert spark.read.parquet(str(tmp_path / "pgs_scaled")).count() == scored.count()
    rows = {r.key: r.value for r in spark.read.parquet(str(tmp_path / "metadata")).collect()}
    assert list(rows) and set(rows) == set(tables.METADATA_KEYS) and rows["total_snps"] == str(merged.count())
    with pytest.raises(tables.DuplicateKeyError):
        tables.write_tables({"pgs_scaled": frames["pgs_scaled"].unionAll(frames["pgs_scaled"])}, str(tmp_path / "again"))


def test_json(spark, sf_dir, merged, tmp_path):
    metadata = tables.run_metadata(run_statistics(merged), "j", "u", "2025-01-01")
    tables.write_json(merged, metadata, str(tmp_path), scale_pgs(Tables(spark, sf_dir).pgs()))
    row = json.loads(spark.read.text(str(tmp_path / "variants")).first().value)
    assert len(row["samples"]) == 51 and row["samples"][50]["sample_id"] == "samp51"
    typed = tables.variant_json(merged.filter("is_typed")).first().value
    assert "imputation_quality" not in json.loads(typed)["samples"][0]
    assert spark.read.json(str(tmp_path / "metadata")).first().job_id == "j"


def test_register(spark, merged, tmp_path):
    import hashlib

    merged.write.parquet(str(tmp_path / "vcf_out"))
    rows = output_register(spark, str(tmp_path / "vcf_out")).collect()
    assert rows and all(r.file_type == "vcf" for r in rows)
    path = rows[0].path.removeprefix("file:")
    assert rows[0].hash_sha256 == hashlib.sha256(open(path, "rb").read()).hexdigest()


def test_sites_are_compared_in_bounded_tasks(spark, merged, monkeypatch):
    """Tasks by the number of rows, and a site of very many copies in several; the greatest by content stays."""
    few = merged.limit(60).persist()
    site = few.orderBy(*SITE_KEY).first()
    hot = few.filter((F.col("chromosome") == site.chromosome) & (F.col("position") == site.position)).crossJoin(spark.range(90)).withColumn(
        "user_dosage", F.col("id") / 100).drop("id")
    rows = few.unionAll(hot).unionAll(few.withColumn("rsid", F.lit(None).cast("string")))
    expected = rows.groupBy(*SITE_KEY).agg(F.max(F.struct(*[c for c in rows.columns if c not in SITE_KEY])).alias("m")).select(
        *[c if c in SITE_KEY else f"m.{c}" for c in rows.columns])
    monkeypatch.setattr(tables, "SITE_ROWS", 30)
    for copies in (1000, 25):
        monkeypatch.setattr(tables, "SITE_COPIES", copies)
        got = tables.one_per_site(rows)
        assert got.count() == expected.count() == 60 and got.exceptAll(expected).count() == 0
    plain = tables._greatest(rows.repartition(7, *SITE_KEY), SITE_KEY, ["rsid", "user_dosage"])
    assert plain.rdd.getNumPartitions() == 7  # the aggregate keeps to the tasks it was dealt to
    few.unpersist()


def test_ranges_follow_the_number_of_rows(spark, merged, monkeypatch):
    """Few bytes in many wide rows are still dealt to as many tasks as their rows ask for."""
    rows = stage(merged, "ranged")
    monkeypatch.setattr(ranges, "RANGE_ROWS", 50)
    many = -(-rows.count() // 50)
    dealt = tables.by_place(rows, staged=True).withColumn("part", F.spark_partition_id()).persist()
    sizes = [r["count"] for r in dealt.groupBy("part").count().collect()]
    assert len(sizes) == many > 8 and max(sizes) < 150
    assert [tuple(r) for r in dealt.select(*SITE_KEY).collect()] == [tuple(r) for r in rows.select(*SITE_KEY).orderBy(*SITE_KEY, "rsid").collect()]
    dealt.unpersist()
    monkeypatch.setattr(ranges, "RANGE_ROWS", 10**6)
    assert ranges.range_count(rows) == min(4, -(-rows.count() // ranges.FEW_ROWS)) and ranges.range_count(rows.filter("false")) == 1


def test_parsed_documents_are_not_sorted(spark, sf_dir):
    plan = QUERIES["json_documents"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "Sort" not in plan


def test_usual_samples_are_joined_as_text(spark, merged):
    """The text equals that made sample by sample, whatever the row holds; only usual rows take the short way."""
    rows = merged.limit(20)
    cells = ["0|0", "0|1", "1|0", "1|1"] * 12 + ["1|1", "0|0"]
    odd = [["0/1"] + cells[1:], cells[:49], [*cells, "0|0"], [None, *cells[1:]], ["0|0\t0|1", *cells[2:], None], ['a"b', *cells[1:]], []]
    for given in odd:
        rows = rows.unionAll(merged.limit(1).withColumn("sample_genotypes", F.lit(given) if given else F.array().cast("array<string>")))
    rows = rows.unionAll(merged.limit(1).withColumn("sample_genotypes", F.lit(None).cast("array<string>")))
    usual = merged.limit(1).withColumn("sample_genotypes", F.lit(cells))
    empty = usual.withColumns({c: F.lit(None).cast(t) for c, t in usual.dtypes if c != "sample_genotypes"})
    brace = usual.withColumns({"rsid": F.lit('x"}}'), "is_typed": F.lit(None).cast("boolean"), "panel_quality": F.lit(float("nan"))})
    rows = rows.unionAll(empty).unionAll(brace).persist()
    wide = with_samples(rows)
    expected = wide.select("chromosome", "position", F.to_json(F.struct(*wide.columns)).alias("value"))
    got = tables.variant_json(rows)
    assert got.count() == expected.count() == 30 and got.exceptAll(expected).count() == 0 and expected.exceptAll(got).count() == 0
    short = rows.select(tables._usual_samples(F.lit("}")).alias("v")).collect()
    assert sum(r.v is None for r in short) == 8
    rows.unpersist()
