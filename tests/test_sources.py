import gzip
import os

import pytest
from pyspark.sql import functions as F

from locusloom.sources import calls, files, lines, panel, pgs, vcf


def put(folder, name, text):
    path = os.path.join(str(folder), name)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


# -- calls -----------------------------------------------------------------------------

CALLS = "# rsid\tchromosome\tposition\tgenotype\nrs1\t1\t100\tAG\n\n rs2 \t 2\t200 \tCC\nrs3\tX\t5\t--\nrs4\tMT\t7\tA\n"


def test_read_calls(spark, tmp_path):
    path = put(tmp_path, "genome_1.txt", CALLS)
    rows = [(r.rsid, r.chromosome, r.position, r.genotype) for r in calls.read_calls(spark, path).orderBy("row_id").collect()]
    assert rows == [("rs1", "1", 100, "AG"), ("rs2", "2", 200, "CC"), ("rs3", "X", 5, "--"), ("rs4", "MT", 7, "A")]
    assert calls.read_calls(spark, path, calls.AUTOSOME_NAMES).count() == 2
    assert [r.rsid for r in calls.read_calls(spark, path, ["X"]).collect()] == ["rs3"]


@pytest.mark.parametrize("text,message", [
    ("rs1\t1\t100\tAG\nrs2\t1\t200\n", "line 2: expected 4 fields, found 3"),
    ("rs1\t1\t100\tAG\nrs2\t1\tabc\tAG\nrs3\t1\n", "line 2: invalid position abc"),
    ("# only\n\n", "no calls found"),
])
def test_bad_calls(spark, tmp_path, text, message):
    path = put(tmp_path, "genome.txt", text)
    with pytest.raises(calls.CallsFormatError, match=message):
        calls.read_calls(spark, path)


def test_line_numbers_over_several_splits(spark, tmp_path):
    path = put(tmp_path, "long.txt", "".join(f"line {i}\n" for i in range(1, 20001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        df = lines.with_line_numbers(lines.read_lines(spark, path))
        assert df.select("split_start").distinct().count() > 2
        assert df.filter(F.col("value") != F.concat(F.lit("line "), F.col("line_no").cast("string"))).count() == 0
        assert df.count() == 20000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


# -- VCF -------------------------------------------------------------------------------

HEADER = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts0\ts1\n"
GOOD = [
    "1\t100\trs1;x\tA\tG\t.\tPASS\tAF=0.2;R2=0.95\tGT:DS\t0|0:0\t0|1:1.02",
    "chr2\t200\t.\tC\tT,G\t.\tPASS\tR2=bad;R2=0.5;DR2=0.9\tGT:HDS:DS\t0|0:0,0:0\t1|1:1,1:2.0",
    "3\t300\t.\tG\tA\t.\tPASS\tDR2=0.4\tDS\t0\t0.5",
]
BAD = [
    "X\t1\t.\tA\tG\t.\t.\tR2=1\tGT:DS\t0|0:0", "1\tp\t.\tA\tG\t.\t.\tR2=1\tDS\t0", "1\t1\t.\tA\t.\t.\t.\tR2=1\tDS\t0",
    "1\t1\t.\tA\tG\t.\t.\tR2=1\tGT\t0|0", "1\t1\t.\tA\tG\t.\t.\tR2=1\tGT:DS\t0|0", "1\t1\t.\tA\tG\t.\t.\tR2=1\tDS\t2.0001",
    "1\t1\t.\tA\tG\t.\t.\tR2=1\tDS\tnan", "1\t1\t.\tA\tG\t.\t.\tR2=1\tDS", "1\t1\t.",
]


def test_read_vcf_two_gzip_members(spark, tmp_path):
    path = str(tmp_path / "chr1.dose.vcf.gz")
    with open(path, "wb") as f:
        f.write(gzip.compress((HEADER + GOOD[0] + "\n").encode()))
        f.write(gzip.compress(("\n".join(GOOD[1:] + BAD) + "\n").encode()))
    read = vcf.read_vcf(spark, path)
    rows = [tuple(r)[:7] for r in read.rows.orderBy("row_id").collect()]
    assert rows == [
        ("rs1", 1, 100, "A", "G", 1.02, 0.95), ("chr2:200:C:T", 2, 200, "C", "T", 2.0, 0.5),
        ("chr3:300:G:A", 3, 300, "G", "A", 0.5, None),
    ]
    assert [r.error for r in read.rejects.orderBy("row_id").collect()] == [
        "invalid chromosome", "invalid position", "missing ALT", "no DS in FORMAT", "no DS in sample", "DS out of range",
        "invalid DS", "no sample column", "missing ALT"]
    report = read.report.first()
    assert (report.data_rows, report.error_rows) == (12, 9)
    assert vcf.read_vcf(spark, path, max_errors=9).rows.count() == 3
    with pytest.raises(vcf.VcfErrorBudgetExceeded, match="9 errors > 8"):
        vcf.read_vcf(spark, path, max_errors=8)


def test_vcf_quality_filter_and_tags(spark, tmp_path):
    path = put(tmp_path, "a.vcf", HEADER + "\n".join(GOOD) + "\n")
    assert vcf.read_vcf(spark, path, min_quality=0.6).rows.count() == 2
    assert vcf.read_vcf(spark, path, min_quality=0.6).report.first().skipped_rows == 1
    rows = vcf.read_vcf(spark, path, quality_tags=("DR2", "R2")).rows.orderBy("position").collect()
    assert [r.imputation_quality for r in rows] == [0.95, 0.9, 0.4]
    assert vcf.scan_vcf(spark, path).count() == 3
    profile = vcf.profile_vcf_lines(spark.read.text(path)).first()
    assert (profile.header_rows, profile.data_rows, profile.quality_rows) == (2, 3, 2)


# -- panel -----------------------------------------------------------------------------

def stored_panel(spark, drop=None):
    import json

    cells = {f"samp{i}": "0|1" for i in range(1, 51) if i != drop}
    return spark.createDataFrame(
        [(1, 100, "rs1", "A", "G", 1, 0.1, 0.1, 0.9, 1, json.dumps(cells)), (2, 50, None, "C", "T", None, None, None, None, None, json.dumps(cells))],
        "chromosome int, position bigint, rsid string, ref_allele string, alt_allele string, phased int, allele_freq double, "
        "minor_allele_freq double, imputation_quality double, is_typed int, sample_genotypes string")


def test_panel_round_trip(spark, tmp_path):
    stored_panel(spark).write.partitionBy("chromosome").parquet(str(tmp_path / "panel"))
    df = panel.read_panel(spark, str(tmp_path / "panel"))
    assert [(r.position, r.is_typed, len(r.sample_genotypes)) for r in df.orderBy("chromosome").collect()] == [(100, True, 50), (50, False, 50)]
    one = panel.read_panel(spark, str(tmp_path / "panel"), [2])
    assert one.count() == 1 and "chromosome" in one._jdf.queryExecution().executedPlan().toString()
    back = panel.panel_from_stored(panel.panel_to_stored(df))
    assert back.exceptAll(df).count() == 0


def test_panel_missing_sample(spark, tmp_path):
    stored_panel(spark, drop=17).write.parquet(str(tmp_path / "bad"))
    with pytest.raises(Exception, match="panel sample missing"):
        panel.read_panel(spark, str(tmp_path / "bad")).collect()


def test_build_panel(spark):
    cells = ", ".join(f"'0|{i % 2}' AS samp{i}" for i in range(1, 51))
    frames = {c: spark.sql(f"SELECT {c * 10} AS bp37, 'rs{c}' AS rsid, 'A' AS REF, 'G' AS ALT, true AS PHASED, 0.1D AS AF, 0.1D AS MAF, 0.9D AS R2, {c % 2} AS TYPED, {cells}") for c in (1, 2)}
    built = panel.build_panel(frames)
    assert [(r.chromosome, r.position, r.is_typed) for r in built.orderBy("chromosome").collect()] == [(1, 10, True), (2, 20, False)]
    assert panel.missing_chromosomes(built).count() == 20
    with pytest.raises(panel.PanelError):
        panel.validate_panel(built.drop("rsid"), spark.createDataFrame([("a", "b")], "key string, value string"))


# -- scores ----------------------------------------------------------------------------

def test_scores_long_and_wide(spark, tmp_path):
    long = put(tmp_path, "scores.txt", "ID,PGS_label,score_value\ns1,height,1.5\ns2,height,-2\n")
    assert sorted(tuple(r) for r in pgs.read_pgs_scores(spark, long).collect()) == [("s1", "height", 1.5), ("s2", "height", -2.0)]
    wide = put(tmp_path, "wide.txt", '"sample","height","bmi"\n"s1","1.5",2\n"s2",3,4\n')
    assert sorted(tuple(r) for r in pgs.read_pgs_scores(spark, wide).collect()) == [
        ("s1", "bmi", 2.0), ("s1", "height", 1.5), ("s2", "bmi", 4.0), ("s2", "height", 3.0)]
    assert pgs.is_wide_header("sample") and not pgs.is_wide_header("ID")


@pytest.mark.parametrize("text", [
    "ID,PGS_label,score_value\ns1,h,inf\n", "ID,PGS_label,score_value\ns1,h,x\n", "ID,PGS_label,score_value\n", "",
    "sample,h,b\ns1,1\n", "sample,h\ns1,NaN\n", "a,b\n1,2\n",
])
def test_bad_scores(spark, tmp_path, text):
    path = put(tmp_path, "scores.txt", text)
    with pytest.raises(pgs.PgsFormatError):
        pgs.read_pgs_scores(spark, path)


def test_weights(spark, tmp_path):
    path = put(tmp_path, "w.txt", "SNP\tCHR\tBP\tA1\tA2\tweight\nrs1\t1\t100\tG\tA\t0.5\n")
    row = pgs.read_pgs_weights(spark, path, "height").first()
    assert (row.trait, row.rsid, row.chromosome, row.position, row.effect_allele, row.weight) == ("height", "rs1", 1, 100, "G", 0.5)


# -- files -----------------------------------------------------------------------------

def test_manifest(spark, tmp_path):
    put(tmp_path, "genome_1.txt", CALLS)
    put(tmp_path, "bad.txt", "hello\nworld\n")
    put(tmp_path, "short.txt", "# 23andMe\nrs1\t1\t2\n")
    put(tmp_path, "scores.txt", "ID,PGS_label,score_value\ns1,h,1\n")
    put(tmp_path, "x.exe", "MZ")
    put(tmp_path, "fake.vcf.gz", "not gzip")
    with open(tmp_path / "chr1.dose.vcf.gz", "wb") as f:
        f.write(gzip.compress((HEADER + GOOD[0] + "\n").encode()))
    with open(tmp_path / "chr2.dose.vcf.gz", "wb") as f:
        f.write(gzip.compress(b"nonsense\n"))
    rows = {r.file_name: r for r in files.ingest_manifest(spark, str(tmp_path)).collect()}
    reasons = {n: r.reason for n, r in rows.items()}
    assert reasons == {
        "genome_1.txt": None, "scores.txt": None, "chr1.dose.vcf.gz": None, "bad.txt": "not a calls file",
        "short.txt": "expected 4 columns", "x.exe": "invalid file type", "fake.vcf.gz": "magic number mismatch",
        "chr2.dose.vcf.gz": "missing fileformat header"}
    import hashlib
    assert rows["genome_1.txt"].hash_sha256 == hashlib.sha256(CALLS.encode()).hexdigest()
    problems = [r.problem for r in files.missing_inputs(files.list_files(spark, str(tmp_path))).collect()]
    assert len(problems) == 21 and "expected 22 VCF files, found 2" in problems


def test_version_rule(spark, tmp_path):
    from locusloom.operators.compare import vcf_version_violations

    put(tmp_path, "a.vcf", HEADER)
    put(tmp_path, "b.vcf", "#CHROM\n")
    bad = vcf_version_violations(lines.read_lines(spark, str(tmp_path))).collect()
    assert len(bad) == 1 and bad[0].file_path.endswith("b.vcf")


def test_missing_inputs_reads_all_files(spark, sf_dir):
    from locusloom.plans import catalog

    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").filter("l_linenumber = 2")
    vcf = lines.filter("l_partkey % 24 + 1 <> 7").count()
    got = {r.problem for r in catalog.QUERIES["missing_inputs_all_files"](spark, sf_dir).collect()}
    assert got == {"missing chr7.dose.vcf.gz", "missing pgs", f"expected 22 VCF files, found {vcf}"}


@pytest.mark.parametrize("tags", [("R2",), ("R2", "DR2")])
def test_filters_on_errors_split_a_line_once(spark, tmp_path, tags):
    """A filter on the result is not pushed into the lines, where each use of a field would split the line again."""
    path = put(tmp_path, "odd.vcf", "##x\n1\t5\trs5\tA\tG\t.\tPASS\tR2=0.5;DR2=0.7\tGT:DS\t0|0:1.5\nX\t6\n2\t7\t.\tA\tG\t.\t.\t.\tGT\t0|0\n")
    parsed = vcf.parse_vcf_lines(lines.read_lines(spark, path), tags)
    good, bad = parsed.filter(F.col("error").isNull()), parsed.filter(F.col("error").isNotNull())
    for rows in (good, bad, vcf.filter_min_quality(good, 0.4).select("rsid"), bad.groupBy("error").count()):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("split(rtrim(") == 1
    assert [(r.rsid, r.position, r.dosage, r.imputation_quality) for r in good.collect()] == [("rs5", 5, 1.5, 0.5)]
    assert sorted((r.position, r.error) for r in bad.collect()) == [(6, "invalid chromosome"), (7, "no DS in FORMAT")]


def test_line_rules_split_a_line_once(spark):
    from locusloom.operators import compare

    vcf_text = spark.createDataFrame([("##fileformat=VCFv4.2", "a"), ("1\t5\t.\tA\tG\t.\t.\tR2=0.5", "a"), ("X\t5\t.\tA\tQ\t.\t.\t.", "a")], "value string, file_path string")
    call_text = spark.createDataFrame([("# c", "g"), (" rs1 \t1\t5\tAG ", "g"), ("rs2\tQ\t5\tA", "g")], "value string, file_path string")
    found = {}
    for rules in (compare.vcf_line_rules(vcf_text, ("R2",)), compare.call_line_rules(call_text, 1)):
        assert rules._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
        found |= {r.rule: r.violations for r in rules.collect()}
    assert found == {"vcf_version": 0, "vcf_chromosome": 1, "vcf_info": 1, "vcf_alleles": 1, "call_header": 0, "call_chromosome": 1, "call_genotype": 1}


def test_block_lines_are_written_by_many_tasks(spark, sf_dir, monkeypatch):
    from locusloom.plans.catalog import QUERIES  # isort: skip
    from locusloom.plans import catalog_files

    paths, write = [], catalog_files.block_sink.write_block_text
    monkeypatch.setattr(catalog_files.block_sink, "write_block_text", lambda rows, path: (paths.append(path), write(rows, path)))
    QUERIES["vcf_from_blocks"](spark, sf_dir)
    parts = [n for n in os.listdir(os.path.join(paths[0].removeprefix("file://"), "data")) if n.endswith(".gz")]
    assert len(parts) == 1 + int(spark.conf.get("spark.sql.shuffle.partitions"))  # and the block that ends the file
