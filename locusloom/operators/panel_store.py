"""The reference panel stored once in buckets by place, so that a merge shuffles the person's side only.

The panel is written as a bucketed table by (chromosome, position, part). ``part`` is 0 but at places that hold more than ``hot`` panel rows:
there the rows are dealt to several parts, and the person's few rows of such a place are copied to each of them. A bucket is
therefore never filled by one place, which adaptive execution could not split in a bucketed scan.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusloom.functions.genotype import passes_quality
from locusloom.operators.merge import DEFAULT_RULES, MergeRules, resolve_user, unique_calls, unique_calls_by_letters, unique_imputed
from locusloom.schemas import SITE_KEY
from locusloom.session import stage, staged_path

PLACE = ["chromosome", "position"]
_BY = [*PLACE, "part"]
#: Rows of one place that stay in one bucket.
HOT = 100_000


@dataclass(frozen=True)
class PanelStore:
    """A stored panel: the bucketed table's name, the panel's columns, and the hot places with their number of parts."""

    spark: SparkSession
    table: str
    columns: list[str]
    hot: DataFrame

    def panel(self) -> DataFrame:
        return self.spark.table(self.table).select(*self.columns)

    def dealt(self, rows: DataFrame) -> DataFrame:
        """The person's rows with ``part``: one copy for each part of their place."""
        parts = F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)).alias("part")
        return rows.join(self.hot, PLACE, "left").select(*rows.columns, parts)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def store_panel(panel: DataFrame, buckets: int | None = None, hot: int = HOT) -> PanelStore:
    """Write the panel in buckets: by default as many as the session's shuffle partitions, which is what a merge then asks for."""
    spark = panel.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = stage(panel, "panel")
    places = rows.groupBy(*PLACE).agg(F.count("*").alias("_n")).filter(F.col("_n") > hot)  # fewer than rows / hot
    hot_places = stage(places.select(*PLACE, F.ceil(F.col("_n") / hot).cast("int").alias("_parts")), "hot-places")
    part = F.pmod(F.monotonically_increasing_id(), F.coalesce("_parts", F.lit(1))).cast("int")
    dealt = rows.join(hot_places, PLACE, "left").withColumn("part", part).drop("_parts")
    name = f"panel_{uuid.uuid4().hex}"
    dealt.repartition(buckets, *_BY).write.bucketBy(buckets, *_BY).sortBy(*_BY).option("path", staged_path(spark, name)).saveAsTable(name)
    return PanelStore(spark, name, panel.columns, hot_places)


def merge_stored(
    store: PanelStore, calls: DataFrame, imputed: DataFrame, rules: MergeRules = DEFAULT_RULES,
    call_order: list[str] | None = None, imputed_order: list[str] | None = None,
) -> DataFrame:
    """What ``merge_multi_sample`` gives, with the panel read from its buckets."""
    if rules.key != "site":
        raise ValueError("a stored panel is merged by site")
    sites = store.spark.table(store.table).filter(passes_quality("imputation_quality", rules.panel_min_r2))
    if rules.call_match == "letters":
        c, call_keys = unique_calls_by_letters(calls, call_order), [*_BY, "ref_allele", "alt_allele"]
    else:
        c, call_keys = unique_calls(calls, PLACE, call_order), _BY
    i = unique_imputed(imputed, SITE_KEY, imputed_order)
    joined = sites.join(store.dealt(c), call_keys, "left").join(store.dealt(i), [*_BY, "ref_allele", "alt_allele"], "left")
    return resolve_user(joined.drop("part"), rules)
