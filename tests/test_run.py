import glob
import gzip

import pytest
from pyspark.sql import functions as F

from locusloom.operators.merge import LIBRARY_RULES, WORKER_RULES
from locusloom.plans.run import RunOptions, run_merge
from locusloom.sinks.tables import read_long_parquet
from tests.test_sources import HEADER, put
from tests.test_streaming import vcf_line
from tests.test_merge import panel_rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("run")
    inputs = base / "in"
    inputs.mkdir()
    put(inputs, "genome_me.txt", "# 23andMe\nr1\t1\t1\tAG\nr2\t1\t2\tGG\nr2\t1\t2\tAA\nr3\tX\t3\tAG\n")
    for c in (1, 2):
        with open(inputs / f"chr{c}.dose.vcf.gz", "wb") as f:
            f.write(gzip.compress((HEADER + "".join(vcf_line(c, p, 1.6, 0.5) for p in (2, 3, 4)) + vcf_line(c, 4, 0.1, 0.2)).encode()))
    put(inputs, "scores.txt", "ID,PGS_label,score_value\ns1,h,1\ns2,h,2\ns3,h,3\n")
    panel = panel_rows(spark, [(c, p, None, "A", "G", 0.95) for c in (1, 2) for p in range(1, 6)] + [(1, 6, None, "A", "G", 0.1)])
    panel.withColumn("phased", F.lit(True)).write.partitionBy("chromosome").parquet(str(base / "panel"))
    return base


def test_full_run(spark, folder):
    out = str(folder / "out")
    options = RunOptions("job1", "me", "2025-01-01T00:00:00Z", formats=["parquet", "vcf", "tables", "json"])
    result = run_merge(spark, str(folder / "in"), str(folder / "panel"), out, options)
    users = {(r.chromosome, r.position): (r.user_genotype, r.user_dosage, r.user_source) for r in result.merged.collect()}
    assert users[1, 1] == ("0|1", 1.0, "Genotyped") and users[1, 2] == ("0|0", 0.0, "Genotyped")
    assert users[2, 3] == ("1|1", 1.6, "Imputed") and users[2, 4] == ("0|0", 0.1, "ImputedLowQual") and users[2, 5] == ("0|0", 0.0, "Imputed")
    assert len(users) == 10
    counters = {r.chromosome: (r.genotyped, r.imputed, r.absent, r.filtered, r.total) for r in result.counters.collect()}
    assert counters == {1: (2, 2, 1, 1, 5), 2: (0, 3, 2, 0, 5)}
    assert read_long_parquet(spark, f"{out}/parquet").count() == 510
    assert spark.read.parquet(f"{out}/tables/variants").count() == 510
    assert glob.glob(f"{out}/vcf/part-*") and glob.glob(f"{out}/json/variants/part-*")
    assert [round(r.z, 4) for r in result.scored.orderBy("sample_id").collect()] == [-1.2247, 0.0, 1.2247]
    assert {r.file_type for r in result.register.collect()} == {"vcf", "result"}
    assert result.metadata.first().total_snps == 10 and result.rejects.count() == 0
    result.release()
    assert read_long_parquet(spark, f"{out}/parquet").count() == 510
    assert not glob.glob(result.staging.folder.removeprefix("file:"))


@pytest.mark.parametrize("rules,expected", [(WORKER_RULES, ("0|1", 1.0, "Genotyped")), (LIBRARY_RULES, ("./.", 0.0, "ImputedLowQual"))])
def test_other_rules(spark, folder, rules, expected, tmp_path):
    options = RunOptions(f"job-{rules.call_match}-{rules.missing}", "me", "2025-01-01", rules=rules, vcf_layout="per_chromosome")
    result = run_merge(spark, str(folder / "in"), str(folder / "panel"), str(tmp_path), options)
    row = result.merged.filter("chromosome = 1 AND position = 1").first()
    assert (row.user_genotype, row.user_dosage, row.user_source) == expected
    assert len(glob.glob(f"{tmp_path}/vcf/chromosome=*")) == 22


def test_missing_inputs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put(tmp_path / "in", "scores.txt", "x")
    with pytest.raises(FileNotFoundError):
        run_merge(spark, str(tmp_path / "in"), "unused", "unused", RunOptions("j", "u", "2025-01-01"))
