"""Genomic and operational frames derived by arithmetic from the star-schema test tables.

The tables hold no genomes, so a site is made of each order key: every order yields one panel row
(50 samples), every line item a measured call (odd line numbers) or an imputed row (even ones) here, and the work of a query grows with its tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusloom.schemas import PANEL_SAMPLES

# How lines that repeat a key are ordered; the last one counts.
CALL_ORDER = ["l_shipdate", "l_partkey", "l_suppkey"]


class Tables:
    """Base tables of one data folder and the frames derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._read: dict[str, DataFrame] = {}

    def base(self, name: str) -> DataFrame:
        if name not in self._read:
            self._read[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._read[name]

    def spread(self, name: str, columns: list[str]) -> DataFrame:
        """A few narrow columns of a table whose rows grow about fiftyfold later, dealt out before they grow.

        With a number, as adaptive execution would else join the short rows into one partition.
        """
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return self.base(name).select(*columns).repartition(parts, *columns)

    # -- sites -------------------------------------------------------------------------

    @staticmethod
    def site_sql(k: str) -> dict[str, str]:
        return {
            "chromosome": f"cast({k} % 22 + 1 as int)", "position": f"{k} * 37 + 10000",
            "ref_allele": f"substr('ACGT', cast({k} % 4 + 1 as int), 1)",
            "alt_allele": f"substr('ACGT', cast(({k} + 1 + {k} % 3) % 4 + 1 as int), 1)",
        }

    @staticmethod
    def _site(k: str) -> dict[str, Column]:
        return {name: F.expr(text) for name, text in Tables.site_sql(k).items()}

    def sites(self) -> DataFrame:
        site = self.site_sql("o_orderkey")
        return self.spread("orders", ["o_orderkey"]).selectExpr("o_orderkey AS k", *[f"{e} AS {n}" for n, e in site.items()])

    def panel(self) -> DataFrame:
        af = "cast(k * 17 % 101 as double) / 100.0D"
        return self.sites().selectExpr(
            "chromosome", "position", "if(k % 13 != 0, concat('rs', k), NULL) AS rsid", "ref_allele", "alt_allele",
            "true AS phased", f"{af} AS allele_freq", f"least({af}, 1.0D - {af}) AS minor_allele_freq",
            "if(k % 11 != 0, cast(700 + k * 7919 % 300 as double) / 1000.0D, NULL) AS imputation_quality",
            "k % 11 = 0 AS is_typed",
            f"transform(sequence(1, {PANEL_SAMPLES}), i -> get(array('0|0', '0|1', '1|0', '1|1'), "
            "cast((k * 3 + i) % 2 * 2 + (k + i * 7) % 2 as int))) AS sample_genotypes",
        )

    def calls(self, lineitem: DataFrame | None = None) -> DataFrame:
        """Array calls: repeated keys, no-calls, indels, off-panel places and chromosome X."""
        site = self.site_sql("l_orderkey")
        ref, alt = site["ref_allele"], site["alt_allele"]
        rows = self.base("lineitem") if lineitem is None else lineitem
        return rows.filter("l_linenumber % 2 = 1").selectExpr(
            "concat('rs', l_orderkey) AS rsid",
            f"if(l_orderkey % 19 = 0, 'X', cast({site['chromosome']} as string)) AS chromosome",
            f"{site['position']} + if(l_orderkey % 17 = 0, 1, 0) AS position",
            f"CASE (l_orderkey + l_suppkey) % 6 WHEN 0 THEN concat({ref}, {ref}) WHEN 1 THEN concat({ref}, {alt}) "
            f"WHEN 2 THEN concat({alt}, {ref}) WHEN 3 THEN concat({alt}, {alt}) WHEN 4 THEN '--' ELSE 'DI' END AS genotype",
            *CALL_ORDER,
        )

    def imputed(self) -> DataFrame:
        """Imputed rows: repeated keys, unknown and low R2, generated names, off-panel places."""
        site = self.site_sql("l_orderkey")
        position = f"{site['position']} + if(l_orderkey % 23 = 0, 2, 0)"
        return self.base("lineitem").filter("l_linenumber % 2 = 0").selectExpr(
            f"if(l_orderkey % 7 = 0, concat_ws(':', concat('chr', {site['chromosome']}), {position}, {site['ref_allele']}, "
            f"{site['alt_allele']}), concat('rs', l_orderkey)) AS rsid",
            f"{site['chromosome']} AS chromosome", f"{position} AS position",
            f"{site['ref_allele']} AS ref_allele", f"{site['alt_allele']} AS alt_allele",
            "cast((l_orderkey * 31 + l_partkey * 7) % 201 as double) / 100.0D AS dosage",
            "if(l_orderkey % 29 != 0, cast(l_orderkey * 613 % 1000 as double) / 1000.0D, NULL) AS imputation_quality",
            *CALL_ORDER,
        )

    def weights(self) -> DataFrame:
        k = F.col("p_partkey")
        site = self._site("p_partkey")
        effect_is_alt = k % 2 == 1
        return self.base("part").select(
            F.col("p_brand").alias("trait"), F.concat(F.lit("rs"), k.cast("string")).alias("rsid"),
            site["chromosome"].alias("chromosome"), site["position"].alias("position"),
            F.when(effect_is_alt, site["alt_allele"]).otherwise(site["ref_allele"]).alias("effect_allele"),
            F.when(effect_is_alt, site["ref_allele"]).otherwise(site["alt_allele"]).alias("other_allele"),
            ((F.col("p_size") - 25).cast("double") / F.lit(1000.0)).alias("weight"),
            ((k * 7919 % 1000 + 1).cast("double") / F.lit(1e9)).alias("p_value"),
        )

    # -- scores ------------------------------------------------------------------------

    def pgs(self) -> DataFrame:
        return self.base("customer").select(
            F.col("c_custkey").cast("string").alias("sample_id"), F.col("c_mktsegment").alias("label"),
            F.col("c_acctbal").alias("value"),
        )

    # -- operations --------------------------------------------------------------------

    def jobs(self) -> DataFrame:
        k = F.col("o_orderkey")
        status = (
            F.when(k % 50 == 0, F.lit("pending")).when(k % 50 == 1, F.lit("expired"))
            .when(F.col("o_orderstatus") == "F", F.lit("completed"))
            .when(F.col("o_orderstatus") == "O", F.lit("processing")).otherwise(F.lit("failed"))
        )

        def later(ts: str, seconds: str) -> Column:
            return F.expr(f"timestampadd(SECOND, {seconds}, {ts})")

        rows = self.base("orders").select(
            k.alias("id"), F.col("o_custkey").cast("string").alias("user_id"), status.alias("status"),
            F.col("o_orderdate").alias("created_at"), F.col("o_custkey").alias("_cust"),
        )
        rows = rows.withColumn("started_at", F.when(F.col("status") != "pending", later("created_at", "cast(id % 7200 as int)")))
        rows = rows.withColumn("completed_at", F.when(
            F.col("status").isin("completed", "failed", "expired"), later("started_at", "cast(id * 7 % 7200 as int)")))
        return rows.select(
            "id", "user_id", "status", "created_at", "started_at", "completed_at",
            F.when(F.col("status").isin("completed", "expired"), later("completed_at", "86400")).alias("expires_at"),
            F.when(F.col("_cust") % 10 != 0, F.concat(F.lit("user"), F.col("user_id"), F.lit("@example.org"))).alias("user_email"),
            (F.col("id") % 7).cast("int").alias("download_attempts"), F.lit(5).alias("max_download_attempts"),
            F.when(F.col("id") % 7 > 0, later("completed_at", "cast(id % 100 as int)")).alias("last_download_attempt"),
            F.when((F.col("status") == "completed") & (F.col("id") % 3 != 0), later("completed_at", "60")).alias("emailed_at"),
            F.when(F.col("id") % 5 == 0, F.lit('{"vcf_format": "per_chromosome"}')).otherwise(F.lit("{}")).alias("metadata"),
        )

    def attempts(self) -> DataFrame:
        e = F.col("event_type")
        return self.base("events").select(
            F.col("event_id").alias("id"), F.col("user_id").alias("job_id"), F.col("ts").alias("attempted_at"),
            F.concat(F.lit("10.0.0."), (F.col("event_id") % 250).cast("string")).alias("ip_address"),
            F.lit("unknown").alias("user_agent"),
            F.when(e == "purchase", "success").when(e == "error", "invalid_password")
            .when(e == "click", "max_attempts_exceeded").when(e == "view", "rate_limited")
            .otherwise("job_expired").alias("attempt_result"),
            (F.col("event_id") % 3 != 0).alias("password_valid"),
        )

    def audit(self) -> DataFrame:
        e, n = F.col("event_type"), F.col("event_id") % 4
        return self.base("events").select(
            F.col("event_id").alias("id"), F.col("ts").alias("timestamp"),
            F.when(e == "error", "login_failure").when(e == "click", "access_denied")
            .when(e == "view", "file_uploaded").when(e == "signup", "job_failed")
            .otherwise("job_completed").alias("event_type"),
            F.col("user_id").cast("string").alias("user_id"),
            F.when(n == 0, "info").when(n == 1, "warning").when(n == 2, "error").otherwise("critical").alias("severity"),
            F.col("props").alias("details"),
        )

    def files(self) -> DataFrame:
        """Job files: one row per line item, type and name by line number."""
        n = F.col("l_linenumber")
        name = (
            F.when(n == 1, F.concat(F.lit("genome_"), F.col("l_orderkey").cast("string"), F.lit(".txt")))
            .when(n == 2, F.concat(F.lit("chr"), (F.col("l_partkey") % 24 + 1).cast("string"), F.lit(".dose.vcf.gz")))
            .when(n == 3, F.lit("scores.txt")).when(n == 4, F.concat(F.lit("../my file_"), F.col("l_suppkey").cast("string"), F.lit(".VCF.GZ")))
            .when(n == 5, F.lit("index.vcf.gz.tbi")).when(n == 6, F.lit(".hidden.txt")).otherwise(F.lit("notes.pgs"))
        )
        return self.base("lineitem").select(
            F.col("l_orderkey").alias("job_id"), name.alias("file_name"),
            F.when(n == 1, "Genome").when(n == 2, "VCF").when(n == 3, "pgs").when(n == 5, "vcf_index").otherwise("result").alias("file_type"),
            (F.col("l_extendedprice") * 3000).cast("bigint").alias("length"),
        )

    def progress(self) -> DataFrame:
        return self.base("events").select(
            F.col("user_id").cast("string").alias("job_id"), (F.col("event_id") % 22 + 1).cast("int").alias("chromosome"),
            F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("message"), F.col("ts").alias("timestamp"),
        )
