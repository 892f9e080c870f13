"""Parquet, JSON and relational sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusloom.functions.genotype import panel_source
from locusloom.operators.merge import SITE_COLUMNS, samples, to_long, user_sample
from locusloom.operators.pgs import pgs_output
from locusloom.schemas import LONG_COLUMNS, PANEL_SAMPLES, SITE_KEY
from locusloom.session import stage
from locusloom.sinks.bins import BinTable
from locusloom.sinks.ranges import NUMBER, in_ranges, numbered, place_keys

# Keys of a run's metadata.
METADATA_KEYS = [
    "job_id", "user_id", "processing_date", "genome_file", "imputation_server", "reference_panel",
    "total_snps", "genotyped_snps", "imputed_snps", "low_quality_snps",
]


class DuplicateKeyError(ValueError):
    """A table that needs unique keys has repeated ones."""


# -- Parquet ---------------------------------------------------------------------------

def by_place(df: DataFrame, staged: bool = False) -> DataFrame:
    """Rows in ranges of place, alleles and identifier, sorted inside.

    Ranges keep the parts even: the largest chromosome has nine times the rows of the smallest, and a place with very
    many rows is dealt to several ranges.
    Range bounds are sampled from the input, which is read twice for that; anything but a
    plain table scan (``staged``) is therefore staged first.
    """
    rows = df if staged else stage(df, "by-place")
    return in_ranges(rows, place_keys(rows))


def write_long_parquet(merged: DataFrame, path: str, partitioned: bool = True, staged: bool = False) -> None:
    """Long table in Snappy Parquet, by chromosome folders or in one folder.

    The compact rows are ranged and sorted, then exploded in place: 51 times fewer rows cross
    the shuffle.
    """
    writer = to_long(by_place(merged, staged)).write.mode("overwrite").option("compression", "snappy")
    (writer.partitionBy("chromosome") if partitioned else writer).parquet(path)


def read_long_parquet(spark, path: str, chromosomes: list[int] | None = None, columns: list[str] | None = None) -> DataFrame:
    """Long table with its columns in order; chromosome filter and columns reach the scan."""
    df = spark.read.parquet(path).withColumn("chromosome", F.col("chromosome").cast("int"))
    if chromosomes:
        df = df.filter(F.col("chromosome").isin(list(chromosomes)))
    return df.select(*(columns or LONG_COLUMNS))


def write_single_parquet(single: DataFrame, path: str) -> None:
    """Single-sample table with its chromosome, which file names alone would carry otherwise."""
    by_place(single).write.mode("overwrite").option("compression", "snappy").partitionBy("chromosome").parquet(path)


# -- JSON ------------------------------------------------------------------------------

#: Dosages of the four phased genotypes that nearly all panel samples have.
_USUAL = {"0|0": "0.0", "0|1": "1.0", "1|0": "1.0", "1|1": "2.0"}


def _usual_samples(rest: Column) -> Column:
    """The panel samples as JSON objects, each with a comma behind it; NULL where a genotype is not a usual one.

    Samples of a row differ in name and genotype only; ``rest`` is what follows the dosage.
    """
    def cell(i: int) -> list[Column]:
        g, middle = F.get("sample_genotypes", F.lit(i)), F
        for text, dosage in _USUAL.items():
            middle = middle.when(g == text, F.lit(f'{text}","dosage":{dosage},'))
        return [F.lit(f'{{"sample_id":"samp{i + 1}","genotype":"'), middle, rest, F.lit(",")]

    return F.when(F.size("sample_genotypes") == PANEL_SAMPLES, F.concat(*[part for i in range(PANEL_SAMPLES) for part in cell(i)]))


def variant_json(merged: DataFrame) -> DataFrame:
    """chromosome, position, ``value``: one JSON document per variant with its 51 samples.

    Absent numbers are left out. Rows of 50 usual genotypes are joined as text in generated code; other rows are made sample by
    sample, which gives the same text.
    """
    rest = F.to_json(F.struct(panel_source("is_typed").alias("source"), F.col("panel_quality").alias("imputation_quality")))
    rows = merged.withColumns({
        "_site": F.rtrim(F.to_json(F.struct(*SITE_COLUMNS)), F.lit("}")),
        "_rest": F.ltrim(rest, F.lit("{"))})
    comma = F.when(F.col("_site") == "{", F.lit("")).otherwise(F.lit(","))
    usual = F.concat("_site", comma, F.lit('"samples":['), _usual_samples(F.col("_rest")), F.to_json(user_sample()), F.lit("]}"))
    whole = F.to_json(F.struct(*SITE_COLUMNS, samples().alias("samples")))
    return rows.select("chromosome", "position", F.coalesce(usual, whole).alias("value"))


def score_json(scored: DataFrame) -> DataFrame:
    return scored.select(F.to_json(F.struct("sample_id", F.col("label").alias("trait_label"), "value", F.col("z").alias("scaled"))).alias("value"))


def write_json(
    merged: DataFrame, metadata: DataFrame, path: str, scored: DataFrame | None = None, staged: bool = False,
) -> None:
    """metadata, variants and scores as JSON lines in folders of their own."""
    metadata.write.mode("overwrite").json(f"{path}/metadata")
    variant_json(by_place(merged, staged)).select("value").write.mode("overwrite").option("compression", "gzip").text(f"{path}/variants")
    if scored is not None:
        score_json(scored).write.mode("overwrite").option("compression", "gzip").text(f"{path}/scores")


# -- metadata --------------------------------------------------------------------------

def run_metadata(statistics: DataFrame, job_id: str, user_id: str, processing_date: str, **names: str) -> DataFrame:
    """One row of run metadata from ``run_statistics`` and names of the inputs."""
    defaults = {
        "genome_file": "array genotype calls", "imputation_server": "imputed VCF",
        "reference_panel": "50 panel samples + user (1 sample) = 51 total",
    }
    given = {**defaults, **names}
    return statistics.select(
        F.lit(job_id).alias("job_id"), F.lit(user_id).alias("user_id"), F.lit(processing_date).alias("processing_date"),
        *[F.lit(given[n]).alias(n) for n in ("genome_file", "imputation_server", "reference_panel")],
        F.col("total").alias("total_snps"), F.col("genotyped").alias("genotyped_snps"),
        F.col("imputed").alias("imputed_snps"), F.col("low_quality").alias("low_quality_snps"))


def metadata_rows(metadata: DataFrame) -> DataFrame:
    """The one-row metadata as key and value text."""
    text = metadata.select(*[F.col(k).cast("string").alias(k) for k in METADATA_KEYS])
    return text.unpivot([], METADATA_KEYS, "key", "value")


def run_summary(counters: DataFrame, register: DataFrame) -> DataFrame:
    """One JSON document: counts per chromosome and output files.

    Both lists are short by nature: 22 chromosomes, and one entry per output folder's file set.
    """
    per_chromosome = counters.groupBy().agg(F.array_sort(F.collect_list(F.struct(
        "chromosome", "total", "genotyped", "imputed",
        F.round(F.try_divide("genotyped", "total") * 100, 3).alias("match_rate")))).alias("chromosomes"))
    files = register.groupBy("file_type").agg(F.count("*").alias("files"), F.sum("length").alias("bytes")).groupBy().agg(
        F.array_sort(F.collect_list(F.struct("file_type", "files", "bytes"))).alias("outputs"))
    both = per_chromosome.withColumn("_k", F.lit(1)).join(F.broadcast(files.withColumn("_k", F.lit(1))), "_k")
    return both.select(F.to_json(F.struct("chromosomes", "outputs")).alias("summary"))


def summary_document(
    counters: DataFrame, metrics: DataFrame, register: DataFrame, job_id: str, user_id: str, created_at: str,
) -> DataFrame:
    """One JSON document of a run: its ids, counts and match rate of each chromosome, and name, size and SHA-256 of each file.

    ``counters`` are those of ``merge_counters``, ``metrics`` those of ``match_metrics`` (the rate is per usable call), ``register``
    that of ``output_register``. Both lists are short by nature: 22 chromosomes, and the part files of one run.
    """
    rate = metrics.select("chromosome", F.round("match_rate", 3).alias("match_rate"))
    chromosome = F.struct(
        F.col("chromosome").alias("chr"), F.col("total").alias("snps_total"), F.col("genotyped").alias("snps_genotyped"),
        (F.col("total") - F.col("genotyped")).alias("snps_imputed"), "match_rate")
    chromosomes = counters.join(rate, "chromosome", "left").agg(F.array_sort(F.collect_list(chromosome)).alias("chromosomes"))
    file = F.struct(F.col("file_name").alias("name"), F.col("length").alias("size"), F.col("hash_sha256").alias("sha256"))
    files = register.agg(F.array_sort(F.collect_list(file)).alias("files"))
    ids = [F.lit(v).alias(n) for n, v in (("job_id", job_id), ("user_id", user_id), ("created_at", created_at))]
    return chromosomes.withColumn("_k", F.lit(1)).join(F.broadcast(files.withColumn("_k", F.lit(1))), "_k").select(
        F.to_json(F.struct(*ids, "chromosomes", "files")).alias("summary"))


# -- relational ------------------------------------------------------------------------

#: Rows that one task sorts by content, and copies of a site from which on they are dealt to several tasks first.
SITE_ROWS, SITE_COPIES = 1 << 15, 1000


def _greatest(rows: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    best = rows.groupBy(*keys).agg(F.max(F.struct(*payload)).alias("_m"))
    return best.select(*keys, *[F.col(f"_m.{c}").alias(c) for c in payload])


def one_per_site(merged: DataFrame, staged: bool = False) -> DataFrame:
    """The greatest row by content of each site.

    Wide rows are sorted for that, so they are dealt to as many tasks as their number asks for: what a task sorts does not
    grow with the table. Copies of a site that has very many are dealt to tasks of their own, and the best of those compared.
    """
    rows = merged if staged else stage(merged, "sites")
    payload = [c for c in merged.columns if c not in SITE_KEY]
    tasks = -(-rows.count() // SITE_ROWS) or 1
    copies = F.count("*").alias("_copies")
    hot = stage(rows.groupBy(*SITE_KEY).agg(copies).filter(F.col("_copies") > SITE_COPIES), "hot-sites")
    if hot.isEmpty():
        return _greatest(rows.repartition(tasks, *SITE_KEY), SITE_KEY, payload).select(*merged.columns)
    part = F.pmod(F.col(NUMBER), F.ceil(F.col("_copies") / SITE_COPIES))
    dealt = numbered(rows).join(hot, SITE_KEY, "left").select(
        *merged.columns, F.coalesce(part, F.lit(-1)).cast("bigint").alias("_part")).repartition(tasks, *SITE_KEY, "_part")
    best = _greatest(dealt, [*SITE_KEY, "_part"], payload)
    few, many = best.filter("_part < 0"), best.filter("_part >= 0")
    return few.select(*merged.columns).unionAll(_greatest(many, SITE_KEY, payload).select(*merged.columns))


def relational_frames(
    merged: DataFrame, metadata: DataFrame, scored: DataFrame | None = None, staged: bool = False,
) -> dict[str, DataFrame]:
    """variants (long), pgs_unscaled, pgs_scaled and metadata.

    Variants are made unique per site while compact; the sample is part of the key, so that is
    the same as making the long rows unique, at a 51st of the rows. Panel rows of one site have
    no order among themselves; the greatest by content is kept.
    """
    unique = one_per_site(merged, staged)
    frames = {"variants": to_long(unique), "metadata": metadata_rows(metadata)}
    if scored is not None:
        frames["pgs_unscaled"] = pgs_output(scored, scaled=False)
        frames["pgs_scaled"] = pgs_output(scored, scaled=True)
    return frames


def variant_table(spark, path: str, schema, width: int | None = None) -> BinTable:
    """The stored variants of a relational export: compact merged rows, one per site, in bins that can be replaced by key."""
    return BinTable(spark, f"{path}/variants", schema, SITE_KEY, width)


def upsert_variants(merged: DataFrame, path: str, version: int | None = None, width: int | None = None) -> int | None:
    """Insert a run's rows or replace those of the same site; the sample is part of the key of the long rows, so replacing the
    compact row replaces all 51. Rows that repeat a site have no order among themselves; the greatest by content is kept."""
    return variant_table(merged.sparkSession, path, merged.schema, width).upsert(merged, [], version)[0]


def check_unique(df: DataFrame, keys: list[str], name: str) -> None:
    bad = df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").limit(1).collect()
    if bad:
        raise DuplicateKeyError(f"{name}: repeated key {bad[0].asDict()}")


def write_tables(frames: dict[str, DataFrame], path: str) -> None:
    """Each frame as a Parquet table below ``path``; variants by chromosome."""
    for name in ("pgs_unscaled", "pgs_scaled"):
        if name in frames:
            check_unique(frames[name], ["sample_id", "trait_label"], name)
    for name, df in frames.items():
        writer = df.write.mode("overwrite")
        (writer.partitionBy("chromosome") if name == "variants" else writer).parquet(f"{path}/{name}")


def write_jdbc(frames: dict[str, DataFrame], url: str, properties: dict[str, str], batch: int = 10000) -> None:
    """Each frame to a database table through Spark's JDBC writer."""
    for name, df in frames.items():
        df.write.mode("append").option("batchsize", batch).jdbc(url, name, properties=properties)
