"""VCF text from merged frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusloom.functions.genotype import genotype_dosage_text
from locusloom.functions.numeric import fixed_decimals
from locusloom.schemas import AUTOSOMES, PANEL_SAMPLES, USER_SAMPLE
from locusloom.session import stage
from locusloom.sinks.blocks import write_block_text
from locusloom.sinks.ranges import NUMBER, numbered, range_count

# Header lines.
_MULTI_HEADER = [
    "##fileformat=VCFv4.3", "##fileDate={date}", "##source={source}",
    '##INFO=<ID=AF,Number=A,Type=Float,Description="Allele Frequency">',
    '##INFO=<ID=MAF,Number=1,Type=Float,Description="Minor Allele Frequency">',
    '##INFO=<ID=TYPED,Number=0,Type=Flag,Description="Variant was genotyped (not imputed)">',
    '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">',
    '##FORMAT=<ID=DS,Number=1,Type=Float,Description="Dosage">',
    '##FORMAT=<ID=IQ,Number=1,Type=Float,Description="Imputation Quality (R²)">',
]
_SINGLE_HEADER = [
    "##fileformat=VCFv4.3", "##fileDate={date}", "##source={source}",
    '##INFO=<ID=DS,Number=1,Type=Float,Description="Dosage">',
    '##INFO=<ID=IQ,Number=1,Type=Float,Description="Imputation Quality (R²)">',
    '##INFO=<ID=SRC,Number=1,Type=String,Description="Data Source (Genotyped/Imputed/ImputedLowQual)">',
]
_SITE_COLUMNS = ["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO"]
SOURCE = "locusloom"


def multi_sample_header(date: str, user_name: str = USER_SAMPLE, source: str = SOURCE) -> list[str]:
    names = [f"samp{i}" for i in range(1, PANEL_SAMPLES + 1)] + [user_name]
    return [x.format(date=date, source=source) for x in _MULTI_HEADER] + ["\t".join([*_SITE_COLUMNS, "FORMAT", *names])]


def single_sample_header(date: str, source: str = SOURCE) -> list[str]:
    return [x.format(date=date, source=source) for x in _SINGLE_HEADER] + ["\t".join(_SITE_COLUMNS)]


def _site(info: Column) -> list[Column]:
    return [
        F.concat(F.lit("chr"), F.col("chromosome").cast("string")), F.col("position").cast("string"), F.col("rsid"),
        F.col("ref_allele"), F.col("alt_allele"), F.lit("."), F.lit("."), info,
    ]


def _carried(rows: DataFrame) -> list[str]:
    return ["chromosome", "position", "ref_allele", "alt_allele", *[c for c in rows.columns if c == "header"]]


def _quality_text(quality: str) -> Column:
    return F.coalesce(fixed_decimals(quality, 3), F.lit("."))


def _panel_cells(end: Column) -> Column:
    """All panel cells as text. ``end`` follows each dosage.

    Where a row has 50 samples with the four usual phased genotypes only, as nearly all have, the cells are joined in generated
    code; other rows are made cell by cell.
    """
    def cell(i: int) -> Column:
        g, text = F.get("sample_genotypes", F.lit(i)), F
        for genotype, n in {"0|0": 0, "0|1": 1, "1|0": 1, "1|1": 2}.items():
            text = text.when(g == genotype, F.lit(("\t" if i else "") + f"{genotype}:{n}.000"))
        return text  # NULL, and with it the whole, for other genotypes

    usual = F.concat(*[part for i in range(PANEL_SAMPLES) for part in (cell(i), end)])
    cells = F.transform("sample_genotypes", lambda g: F.concat(g, F.lit(":"), genotype_dosage_text(g)))
    general = F.concat(F.call_function("array_join", cells, F.concat(end, F.lit("\t"))), end)
    return F.coalesce(F.when(F.size("sample_genotypes") == PANEL_SAMPLES, usual), general)


def multi_sample_lines(merged: DataFrame) -> DataFrame:
    """Place, alleles and ``value``: one VCF line per variant, GT:DS:IQ for 51 samples.

    All panel samples of a row share their quality, so it is formatted once a row.
    """
    items = F.concat_ws(
        ";", F.concat(F.lit("AF="), fixed_decimals("allele_freq", 4)),
        F.concat(F.lit("MAF="), fixed_decimals("minor_allele_freq", 4)), F.when(F.col("is_typed"), F.lit("TYPED")))
    info = F.when(items == "", F.lit(".")).otherwise(items)
    end = F.concat(F.lit(":"), _quality_text("panel_quality"))
    rows, panel = merged.withColumn("_end", end), _panel_cells(F.col("_end"))
    user = F.concat_ws(":", "user_genotype", fixed_decimals("user_dosage", 3), _quality_text("user_quality"))
    return rows.select(*_carried(rows), F.concat_ws("\t", *_site(info), F.lit("GT:DS:IQ"), panel, user).alias("value"))


def single_sample_lines(merged: DataFrame) -> DataFrame:
    """VCF lines of a single-sample merge: DS, IQ and SRC in INFO."""
    info = F.concat_ws(
        ";", F.concat(F.lit("DS="), fixed_decimals("dosage", 3)),
        F.concat(F.lit("IQ="), fixed_decimals("imputation_quality", 3)), F.concat(F.lit("SRC="), F.col("source")))
    return merged.select(*_carried(merged), F.concat_ws("\t", *_site(info)).alias("value"))


_ORDER = ["chromosome", "position", "ref_allele", "alt_allele"]


def _ordered_lines(
    rows: DataFrame, to_lines: Callable[[DataFrame], DataFrame], header: list[str], chromosomes: list[int], staged: bool,
) -> DataFrame:
    """chromosome, position and ``value`` of all lines in order, each chromosome's header (below position 0) before its lines.

    Header lines join the rows before they are sorted, as rows with a place below all others;
    the rows themselves are sorted as they are and turned into text afterwards, because text
    is longer and sorting samples its input first.
    """
    rows = rows if staged else stage(rows, "vcf-rows")
    spark = rows.sparkSession
    top = [(c, i - len(header), "", "", text) for c in chromosomes for i, text in enumerate(header)]
    head = spark.createDataFrame(top, "chromosome int, position bigint, ref_allele string, alt_allele string, header string")
    # The number splits a place with very many rows; header lines have none.
    both = numbered(rows).unionByName(head, allowMissingColumns=True)
    ordered = both.repartitionByRange(range_count(rows), *_ORDER, NUMBER).sortWithinPartitions(*_ORDER, NUMBER)
    return to_lines(ordered).select("chromosome", "position", F.coalesce("header", "value").alias("value"))


def write_merged_vcf(
    rows: DataFrame, path: str, header: list[str], to_lines: Callable[[DataFrame], DataFrame] = multi_sample_lines,
    compression: str = "gzip", staged: bool = False,
) -> None:
    """One VCF as ordered text parts.

    The header sorts first and the parts are ranges of place, so the part files joined in name
    order are one valid file (gzip members may be joined as they are).
    """
    lines = _ordered_lines(rows, to_lines, header, [0], staged)
    lines.select("value").write.mode("overwrite").option("compression", compression).text(path)


def write_vcf_per_chromosome(
    rows: DataFrame, path: str, header: list[str], to_lines: Callable[[DataFrame], DataFrame] = multi_sample_lines,
    compression: str = "gzip", staged: bool = False,
) -> None:
    """One folder ``chromosome=N`` per autosome, each a VCF of ordered text parts."""
    lines = _ordered_lines(rows, to_lines, header, list(AUTOSOMES), staged)
    lines.drop("position").write.mode("overwrite").option("compression", compression).partitionBy("chromosome").text(path)


def write_block_vcf(
    rows: DataFrame, path: str, header: list[str], to_lines: Callable[[DataFrame], DataFrame] = multi_sample_lines, staged: bool = False,
) -> None:
    """One VCF as ordered block-compressed parts with a linear index, see ``sinks.blocks``."""
    write_block_text(_ordered_lines(rows, to_lines, header, [0], staged), path)
