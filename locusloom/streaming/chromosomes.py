"""Incremental merge: imputed files arrive over time, and the bins of position that they touch are merged anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from locusloom.operators.merge import DEFAULT_RULES, MergeRules, autosomal, merge_multi_sample
from locusloom.operators.stats import run_statistics
from locusloom.schemas import AUTOSOMES, IMPUTED_ROWS, SITE_KEY
from locusloom.session import stage
from locusloom.sinks.bins import BinTable
from locusloom.sources.lines import LINE_ORDER
from locusloom.sources.vcf import DEFAULT_MAX_ERRORS, VcfErrorBudgetExceeded, file_report, parse_vcf_lines

_RECEIVED = (
    "rsid string, chromosome int, position bigint, ref_allele string, alt_allele string, dosage double, "
    "imputation_quality double, file_path string, split_start bigint, row_id bigint, value string, error string, batch bigint"
)


class ChromosomeFeed:
    """Keeps a merged table up to date with arriving VCF text files.

    Four tables in the same bins of position, as wide as the panel's rows ask for unless a width is given: panel and calls, written once; the imputed rows that count so far, one per site (the
    last to arrive); and the merge. A batch rewrites the bins of its own rows in the last two, from what
    those bins hold, so its cost does not grow with the batches before it. Versions bear the batch's number: a batch that
    is replayed after a failure starts from the version before it, and readers see whole versions only.

    A file with more than ``max_errors`` bad lines stops the batch before anything changes, or with ``on_excess="skip"``
    is left out and listed in ``refused``. Rows received are logged per batch as they came.
    """

    def __init__(
        self, spark: SparkSession, panel: DataFrame, calls: DataFrame, table_path: str, rules: MergeRules = DEFAULT_RULES,
        width: int | None = None, max_errors: int = DEFAULT_MAX_ERRORS, on_excess: str = "fail",
    ):
        if rules.key != "site":
            raise ValueError("a feed merges by site")
        if on_excess not in ("fail", "skip"):
            raise ValueError("on_excess must be fail or skip")
        self.spark, self.panel, self.calls, self.rules = spark, panel, autosomal(calls), rules
        self.max_errors, self.on_excess = max_errors, on_excess
        self.rows_path, self.refused_path = f"{table_path}/received", f"{table_path}/refused"
        place = ["chromosome", "position"]
        self.panel_bins = BinTable(spark, f"{table_path}/panel", panel.schema, place, width)
        self.call_bins = BinTable(spark, f"{table_path}/calls", self.calls.schema, place, width)
        self.state = BinTable(spark, f"{table_path}/state", IMPUTED_ROWS, SITE_KEY, width)
        empty = spark.createDataFrame([], IMPUTED_ROWS)
        self.table = BinTable(spark, f"{table_path}/merged", self._merge(panel, self.calls, empty).schema, SITE_KEY, width)

    def _merge(self, panel: DataFrame, calls: DataFrame, imputed: DataFrame) -> DataFrame:
        return merge_multi_sample(panel, calls, imputed, self.rules, None, [])

    def initialise(self) -> None:
        """Write panel and calls in bins, and every bin's merge from them alone, as version 0."""
        # Dealing rows to ranges reads them twice.
        panel, calls = stage(self.panel, "feed-panel"), stage(self.calls, "feed-calls")
        self.panel_bins.fit(panel, 0)
        self._align()
        for table, rows in ((self.panel_bins, panel), (self.call_bins, calls)):
            table.replace(rows, table.touched(rows), 0)
        panel = self.panel_bins.read(0)
        empty = self.spark.createDataFrame([], IMPUTED_ROWS)
        merged = stage(self._merge(panel, self.call_bins.read(0), empty), "feed-merged")
        self.table.replace(merged, self.panel_bins.touched(panel), 0)

    def _align(self) -> None:
        """All tables have the panel's bins."""
        self.call_bins.width = self.state.width = self.table.width = self.panel_bins.width

    def start(self, folder: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
        lines = self.spark.readStream.format("text").load(folder).select(
            "value", F.col("_metadata.file_path").alias("file_path"),
            F.col("_metadata.file_block_start").alias("split_start"))
        writer = lines.writeStream.foreachBatch(self.append).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()

    def append(self, lines: DataFrame, batch_id: int) -> None:
        """One batch of VCF lines; version ``batch_id`` of the state and ``batch_id + 1`` of the merge."""
        self._align()
        numbered = lines.withColumn("row_id", F.monotonically_increasing_id())
        parsed = parse_vcf_lines(numbered).withColumns({
            "value": F.when(F.col("error").isNotNull(), F.col("value")), "batch": F.lit(batch_id)})
        rows = self._within_budget(stage(parsed.select(*self._columns()), "feed-rows"), batch_id)
        self._overwrite(rows, self.rows_path)
        good = rows.filter(F.col("error").isNull()).select(*IMPUTED_ROWS.fieldNames(), *LINE_ORDER)
        version, bins = self.state.upsert(good, LINE_ORDER, batch_id)
        if not bins.isEmpty():
            here = self._merge(self.panel_bins.read(bins=bins), self.call_bins.read(bins=bins), self.state.read(version, bins))
            self.table.replace(stage(here, "feed-merged"), bins, batch_id + 1)

    def _within_budget(self, rows: DataFrame, batch_id: int) -> DataFrame:
        over = file_report(rows).filter(F.col("error_rows") > self.max_errors)
        first = over.orderBy("file_path").first()
        if first is None:
            return rows
        if self.on_excess == "fail":
            raise VcfErrorBudgetExceeded(f"{first.file_path}: {first.error_rows} errors > {self.max_errors}")
        refused = stage(over.withColumn("batch", F.lit(batch_id).cast("bigint")), "feed-refused")
        self._overwrite(refused, self.refused_path)
        return rows.join(refused.select("file_path"), "file_path", "left_anti").select(*rows.columns)

    def received(self) -> DataFrame:
        """Good rows of all batches."""
        return self._lines().filter(F.col("error").isNull()).drop("value", "error")

    def rejects(self) -> DataFrame:
        return self._lines().filter(F.col("error").isNotNull()).select("file_path", "value", "error", "batch")

    def refused(self) -> DataFrame:
        """Files that were left out: file_path, counts and batch."""
        schema = "file_path string, data_rows bigint, error_rows bigint, skipped_rows bigint, batch bigint"
        return self._log(schema, self.refused_path)

    def _lines(self) -> DataFrame:
        return self._log(_RECEIVED, self.rows_path)

    def _log(self, schema: str, path: str) -> DataFrame:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def _columns(self) -> list[str]:
        return [*IMPUTED_ROWS.fieldNames(), *LINE_ORDER, "value", "error", "batch"]

    def merged(self) -> DataFrame:
        return self.table.read()

    def totals(self) -> DataFrame:
        """Running totals, counted from the table itself."""
        return run_statistics(self.merged())

    def missing(self) -> DataFrame:
        """Chromosomes for which no row was received yet, from the names of the state's bins alone."""
        wanted = self.spark.range(AUTOSOMES.start, AUTOSOMES.stop).select(F.col("id").cast("int").alias("chromosome"))
        return wanted.join(self.state.manifest(self.state.version()).select("chromosome").distinct(), "chromosome", "left_anti")

    def _overwrite(self, df: DataFrame, path: str) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)
