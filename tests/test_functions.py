import math
import random
from decimal import ROUND_HALF_EVEN, Decimal

import pytest
from pyspark.sql import functions as F

from locusloom.functions import genotype as G
from locusloom.functions import numeric as N
from locusloom.functions import text as X


def values(spark, rows, schema, **columns):
    df = spark.createDataFrame(rows, schema).coalesce(1)
    return [tuple(r) for r in df.select(*[c.alias(n) for n, c in columns.items()]).collect()]


DOSAGE = [
    ("TT", "T", "C", 0.0, "ok"), ("TC", "T", "C", 1.0, "ok"), ("CT", "T", "C", 1.0, "ok"), ("CC", "T", "C", 2.0, "ok"),
    ("--", "T", "C", None, "missing"), ("", "T", "C", None, "missing"), ("T", "T", "C", None, "invalid_format"),
    ("TTC", "T", "C", None, "invalid_format"), ("TG", "T", "C", None, "alleles_mismatch"),
    ("AA", "A", "AG", None, "alleles_mismatch"), ("AA", "AG", "A", None, "alleles_mismatch"),
    ("DI", "T", "C", None, "alleles_mismatch"), (None, "T", "C", None, "missing"),
]


def test_call_dosage_table(spark):
    got = values(spark, [r[:3] for r in DOSAGE], "g string, r string, a string",
                 d=G.call_dosage("g", "r", "a"), s=G.call_status("g", "r", "a"))
    assert got == [r[3:] for r in DOSAGE]


def test_all_nucleotide_pairs_and_their_swap(spark):
    rows = [(x + y, r, a) for r in "ACGT" for a in "ACGT" if a != r for x in (r, a) for y in (r, a)]
    got = values(spark, rows, "g string, r string, a string", d=G.call_dosage("g", "r", "a"), swapped=G.call_dosage("g", "a", "r"))
    for (g, _r, a), (d, swapped) in zip(rows, got):
        assert d == g.count(a)
        assert d + swapped == 2


def test_flip(spark):
    assert values(spark, [("AT",), ("CG",), ("AC",), ("--",)], "g string", f=G.flip_strand("g")) == [("TA",), ("GC",), ("TG",), ("--",)]
    rows = [("AG", "T", "C"), ("AA", "A", "T"), ("CA", "A", "G")]
    got = values(spark, rows, "g string, r string, a string", d=G.call_dosage_with_flip("g", "r", "a"))
    assert got == [(1.0,), (0.0,), (None,)]


def test_dosage_to_genotype_cuts(spark):
    rows = [(x,) for x in (0.0, 0.24999, 0.25, 0.49999, 0.5, 1.24999, 1.25, 1.49999, 1.5, 2.0)]
    got = values(spark, rows, "d double", n=G.dosage_genotype("d"), h=G.dosage_genotype("d", "half_step"))
    assert [g[0] for g in got] == ["0|0"] * 4 + ["0|1"] * 4 + ["1|1"] * 2
    assert [g[1] for g in got] == ["0|0"] * 2 + ["0|1"] * 4 + ["1|1"] * 4
    with pytest.raises(ValueError):
        G.dosage_genotype("d", "other")


def test_genotype_text_dosage(spark):
    rows = ["0|1", "1/1", "./.", "1|2", "0", "", "1|1|1", "x|1", "1|", "10|2", "+1|1"]
    got = values(spark, [(r,) for r in rows], "g string", d=G.genotype_text_dosage("g"), t=G.genotype_dosage_text("g"), m=G.has_extra_alleles("g"))
    assert [g[0] for g in got] == [1.0, 2.0, 0.0, 3.0, 0.0, 0.0, 0.0, 1.0, 1.0, 12.0, 2.0]
    assert [float(g[1]) for g in got] == [g[0] for g in got]
    assert [r for r, g in zip(rows, got) if g[2]] == ["1|2", "10|2"]


def test_sources_and_quality(spark):
    got = values(spark, [(0.29,), (0.3,), (0.95,), (0.85,), (0.9,), (None,)], "q double",
                 s=G.imputed_source("q"), p=G.passes_quality("q", 0.9), n=G.passes_quality("q", None))
    assert [g[0] for g in got] == ["ImputedLowQual"] + ["Imputed"] * 5
    assert [g[1] for g in got] == [False, False, True, False, True, True]
    assert all(g[2] for g in got)


def test_chromosomes(spark):
    rows = ["1", "chr1", "22", "chr22", "X", "23", "chr0", "chrchr5", "chr", "1x"]
    got = values(spark, [(r,) for r in rows], "c string", v=G.vcf_chromosome("c"), a=G.autosome_number("c"))
    assert [g[0] for g in got] == [1, 1, 22, 22, None, None, None, 5, None, None]
    assert [g[1] for g in got] == [1, None, 22, None, None, None, None, None, None, None]


def test_parse_double_refuses_what_a_cast_takes(spark):
    rows = ["1.5", "-2", ".5", "5.", "1e3", "+1E-2", " 1", "1 ", "1.5d", "nan", "inf", "", "1e", "0x1"]
    got = [g[0] for g in values(spark, [(r,) for r in rows], "t string", v=N.parse_double("t"))]
    assert got == [1.5, -2.0, 0.5, 5.0, 1000.0, 0.01] + [None] * 8
    assert values(spark, [("12",), ("-1",), ("9223372036854775808",), ("1.0",)], "t string", v=N.parse_position("t")) == [(12,), (None,), (None,), (None,)]


def test_is_finite(spark):
    got = values(spark, [(1.0,), (float("nan"),), (float("inf"),), (float("-inf"),), (None,)], "v double", f=N.is_finite("v"))
    assert got == [(True,), (False,), (False,), (False,), (False,)]


def test_fixed_decimals_round_the_binary_value(spark):
    rng = random.Random(7)
    numbers = [0.0, 0.0625, 0.1875, 0.3125, 1.0005, 2.0, 0.9995, 1.9995, 0.0005, 12345.6785, 0.99999, -0.5, -1.0625]
    numbers += [3000000000.5, 1048576.0625, 2.0**40 + 0.3, 4194303.99999, -123456789.125]
    numbers += [rng.random() * 2**rng.randint(20, 51) for _ in range(500)]
    numbers += [rng.random() * 2 for _ in range(2000)] + [rng.randrange(20000) / 10000 for _ in range(2000)]
    got = values(spark, [(x,) for x in numbers], "x double", a=N.fixed_decimals("x", 3), b=N.fixed_decimals("x", 4))
    for x, (a, b) in zip(numbers, got):
        assert a == f"{x:.3f}" == str(Decimal(x).quantize(Decimal("0.001"), ROUND_HALF_EVEN))
        assert b == f"{x:.4f}"


def test_normal_distribution(spark):
    got = values(spark, [(0.0,), (3.5,), (-1.96,)], "z double", p=N.normal_cdf("z"))
    assert [round(g[0], 4) for g in got] == [0.5, 0.9998, 0.025]
    series = values(spark, [(1,)], "i int", s=N.density_series())[0][0]
    assert len(series) == 81 and series[40].z == 0.0
    assert abs(series[40].density - 0.3989423) < 1e-6


def test_trait_prediction(spark):
    got = values(spark, [(0.0946, 3.5, 3.0, 14.0)], "r double, z double, s double, m double", v=N.predicted_trait_value("r", "z", "s", "m"))
    assert abs(got[0][0] - 17.2295) < 1e-4


def test_file_names(spark):
    rows = ["../../../etc/passwd", "a\x00b", "a\nb", "a b.txt", "x" * 300]
    got = [g[0] for g in values(spark, [(r,) for r in rows], "n string", s=X.safe_file_name("n"))]
    assert got[:4] == [".._.._.._etc_passwd", "a_b", "ab", "ab.txt"]
    assert len(got[4]) == 255
    rows = ["a.vcf.gz", "a.vcf.gz.tbi", "a.TXT", "noext", "a.pgs", "a.txt.gz"]
    got = values(spark, [(r,) for r in rows], "n string", e=X.file_extension("n"), p=X.file_extension("n", True))
    assert [g[0] for g in got] == ["vcf.gz", "vcf.gz.tbi", "txt", "noext", "pgs", "gz"]
    assert [g[1] for g in got] == ["vcf.gz", "vcf.gz.tbi", "txt", "noext", "pgs", "pgs"]


def test_parameters(spark):
    assert [X.parse_threshold(t) for t in ("none", "R080", "0.8", "r090", "0.9", "junk", None)] == [None, 0.8, 0.8, 0.9, 0.9, 0.9, 0.9]
    assert X.parse_formats(None) == ["parquet", "vcf"] and X.parse_formats(["VCF", "vcf", "json"]) == ["vcf", "json"]
    with pytest.raises(ValueError):
        X.parse_formats(["rdata"])
    got = values(spark, [('{"vcf_format":"per_chromosome"}',), ('{"vcf_format":"x"}',), ("{}",), (None,)], "m string", v=X.vcf_layout("m"))
    assert got == [("per_chromosome",), ("merged",), ("merged",), ("merged",)]


def test_audit_texts(spark):
    rows = [("auth_failure",), ("access_denied",), ("malware_detected",), ("job_failed",), ("file_rejected",), ("job_created",), (None,)]
    assert [g[0] for g in values(spark, rows, "e string", s=X.audit_severity("e"))] == ["warning"] * 3 + ["error", "critical", "info", "info"]
    rows = [("login_failure", "info"), ("access_denied", "error"), ("job_failed", "error"), ("x", "critical"), (None, None)]
    assert [g[0] for g in values(spark, rows, "e string, s string", f=X.is_security_event("e", "s"))] == [True, True, False, True, False]
    assert [g[0] for g in values(spark, [("A.b+c@x-y.ORG",), ("a@b",), ("a b@c.de",)], "e string", ok=X.is_email("e"))] == [True, False, False]


def test_sample_map_round_trip(spark):
    cells = [f"{i % 2}|{i % 3 % 2}" for i in range(50)]
    df = spark.createDataFrame([(cells,)], "g array<string>").select(X.array_to_sample_map("g").alias("j"))
    assert df.select(X.sample_map_to_array("j").alias("g")).first().g == cells
    short = spark.createDataFrame([('{"samp1":"0|1"}',)], "j string").select(X.sample_map_to_array("j", 2).alias("g")).first().g
    assert short == ["0|1", None]


def test_heterozygous_and_display(spark):
    got = values(spark, [("AG", "A", "G"), ("GG", "A", "G"), ("--", "A", "G"), ("DI", "A", "G")], "g string, r string, a string",
                 h=G.is_heterozygous("g"), d=G.display_call("g", "r", "a"), n=F.length("g"))
    assert [g[:2] for g in got] == [(True, "0/1"), (False, "1/1"), (None, "./."), (None, "./.")]


def test_fixed_decimals_of_odd_numbers(spark):
    got = values(spark, [(x,) for x in (float("nan"), float("inf"), -1e300, None, -0.0, 2.0 ** 62)], "x double", a=N.fixed_decimals("x", 3))
    assert [r[0] for r in got] == ["NaN", "inf", "-inf", None, "0.000", "4611686018427387904.000"]


def test_usual_decimals_need_no_exact_steps(spark):
    """The short way gives the rounded binary value too, also beside ties; odd numbers take the long one."""
    rng = random.Random(3)
    numbers = [rng.random() * 10 ** rng.randint(-6, 4) for _ in range(3000)]
    for n in range(2000):
        tie = rng.randint(0, 3000) + rng.choice([0.0625, 0.0005, 0.5005, 0.125, 0.00005, 0.0000005])
        numbers += [tie, math.nextafter(tie, 0), math.nextafter(tie, 9e9), -tie, tie + 0.0009]
    for places in (1, 3, 4, 6):
        got = values(spark, [(x,) for x in numbers], "x double", a=N.fixed_decimals("x", places))
        assert [g[0] for g in got] == [f"{x:.{places}f}" for x in numbers]
