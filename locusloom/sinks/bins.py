"""Tables in bins of position with versions: a change rewrites only the bins it touches, readers see whole versions.

Rows lie in folders ``data/version=V/chromosome=C/bin=B``, where a bin is ``width`` positions. A manifest for each version names, for every bin,
the version that holds its rows. A change writes the bins it touches under the next version's number and then that
version's manifest: until the manifest stands, readers keep to the one before. The manifest has one row per bin, so it may be
broadcast, and readers list exactly the folders it names.

Without a given width the first rows of a table set it, so that a bin holds about ``BIN_ROWS`` of them: there are as many
folders and files as the rows fill, and not one for every stretch of the genome with a few rows in it. The width stands in the manifest.

A change that is repeated under its own number (after a lost driver) starts again from the version before it and overwrites what it had written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locusloom.operators.dedup import last_wins
from locusloom.session import stage

BIN = ["chromosome", "bin"]
WIDTH = 1_000_000  # of a table that has no rows
BIN_ROWS = 1 << 15
_MANIFEST = "chromosome int, bin bigint, version bigint"
_STORED = "chromosome int, bin bigint, held bigint, width bigint"


def bin_of(position: str = "position", width: int = WIDTH) -> Column:
    return F.expr(f"{position} div {width}")


def fitting_width(rows: DataFrame, bin_rows: int | None = None) -> int | None:
    """Positions that hold about ``bin_rows`` rows, by where the middle nine tenths of each chromosome's rows lie; None without rows."""
    ends = F.percentile_approx("position", [0.05, 0.95], 1000)
    per_chromosome = rows.groupBy("chromosome").agg(F.count("position").alias("n"), ends.alias("e")).filter("n > 0")
    found = per_chromosome.agg(F.sum(F.col("n")).alias("n"), F.sum(F.col("e")[1] - F.col("e")[0] + 1).alias("span")).first()
    return max(1, -(-int(found.span) * (bin_rows or BIN_ROWS) * 10 // (int(found.n) * 9))) if found.n else None


def _placed(column: Column, kind: str) -> Column:
    """The column; rows without it have no bin and end the write with an error."""
    return F.coalesce(column, F.raise_error(F.lit("a row without chromosome or position can't be stored")).cast(kind))


class BinTable:
    """A table with ``chromosome``, ``position`` and further columns, at most one row per key after ``upsert``."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], width: int | None = None):
        if not {"chromosome", "position"} <= set(keys):
            raise ValueError("keys must hold chromosome and position")
        self.spark, self.path, self.schema, self.keys, self._width = spark, path.rstrip("/"), schema, keys, width
        self._stored = T.StructType([f for f in schema if f.name != "chromosome"]).add("version", "long").add("chromosome", "integer").add("bin", "long")

    # -- width ---------------------------------------------------------------------------

    @property
    def width(self) -> int:
        """Positions of a bin: as given, or as stored with the newest version."""
        return self._width or self._stored_width(self.version()) or WIDTH

    @width.setter
    def width(self, width: int) -> None:
        self._width = width

    def _stored_width(self, version: int | None) -> int | None:
        row = None if version is None else self._manifest(version).first()
        return row and (row.width or WIDTH)  # tables from before widths were stored

    def fit(self, rows: DataFrame, below: int | None = None) -> None:
        """Keep to the stored width; where no version (below a number) has rows, let these set it."""
        if self._width is None:
            self._width = self._stored_width(self.version(below)) or fitting_width(rows)

    # -- versions ------------------------------------------------------------------------

    def versions(self) -> list[int]:
        """Numbers of the versions that stand, oldest first: one folder each, listed by name."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        system = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(folder):
            return []
        names = {s.getPath().getName(): s.getPath() for s in system.listStatus(folder)}
        done = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(int(n.split("=")[1]) for n, p in names.items() if n.startswith("version=") and system.exists(done(p, "_SUCCESS")))

    def version(self, below: int | None = None) -> int | None:
        """The newest version, or the newest before a number."""
        found = [v for v in self.versions() if below is None or v < below]
        return found[-1] if found else None

    def manifest(self, version: int | None) -> DataFrame:
        """Bins and the version that holds their rows, as of a version."""
        if version is None:
            return self.spark.createDataFrame([], _MANIFEST)
        return self._manifest(version).select("chromosome", "bin", F.col("held").alias("version"))

    def _manifest(self, version: int) -> DataFrame:
        return self.spark.read.schema(_STORED).parquet(f"{self.path}/manifest/version={version}")

    # -- reading -------------------------------------------------------------------------

    def read(self, version: int | None = None, bins: DataFrame | None = None) -> DataFrame:
        """All rows as of a version (the newest), or those of some bins."""
        held = self.manifest(self.version() if version is None else version)
        if bins is not None:
            held = held.join(F.broadcast(bins.select(*BIN)), BIN, "left_semi")
        folders = [f"{self.path}/data/version={r.version}/chromosome={r.chromosome}/bin={r.bin}" for r in held.collect()]  # one per bin
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self._stored).option("basePath", f"{self.path}/data").parquet(*sorted(folders))
        return rows.select(*self.schema.fieldNames())

    def touched(self, rows: DataFrame) -> DataFrame:
        return rows.select("chromosome", bin_of(width=self.width).alias("bin")).distinct()

    # -- changes -------------------------------------------------------------------------

    def replace(self, rows: DataFrame, bins: DataFrame, version: int | None = None) -> int:
        """Put ``rows`` in place of all rows of ``bins`` (bins without rows become empty); the new version's number."""
        before = self.version(version)
        version = (-1 if before is None else before) + 1 if version is None else version
        width = self.width
        order = [c for c in self.keys if c not in ("chromosome", "position")]
        placed = rows.select(*self.schema.fieldNames(), _placed(bin_of(width=width), "bigint").alias("bin")).withColumn(
            "chromosome", _placed(F.col("chromosome"), "int"))
        # Ranges down to the whole key split a bin, and a place, that holds very many rows.
        dealt = placed.repartitionByRange("chromosome", "bin", "position", *order).sortWithinPartitions("chromosome", "bin", "position", *order)
        dealt.write.mode("overwrite").partitionBy(*BIN).parquet(f"{self.path}/data/version={version}")
        kept = self.manifest(before).join(F.broadcast(bins.select(*BIN)), BIN, "left_anti")
        written = self.spark.read.schema(self._stored).parquet(f"{self.path}/data/version={version}").select(*BIN).distinct()
        now = kept.unionByName(written.withColumn("version", F.lit(version).cast("bigint")))
        now.select("chromosome", "bin", F.col("version").alias("held"), F.lit(width).cast("bigint").alias("width")).coalesce(1).write.mode("overwrite").parquet(
            f"{self.path}/manifest/version={version}")
        return version

    def upsert(self, rows: DataFrame, order: list[str], version: int | None = None) -> tuple[int | None, DataFrame]:
        """Insert rows or replace those of the same key; of rows that repeat a key, the last by ``order`` counts.

        Returns the new version and the bins that were touched. Rows that are stored already lose against every new one.
        Only touched bins are read and written, so the cost depends on the batch and on what its bins hold, not on what came before.
        """
        payload = [c for c in self.schema.fieldNames() if c not in self.keys]
        new = stage(last_wins(rows, self.keys, order, payload).select(*self.schema.fieldNames()), "upsert-rows")
        self.fit(new, version)
        bins = stage(self.touched(new), "upsert-bins")
        before = self.version(version)
        if bins.isEmpty():
            return before, bins
        stays = self.read(before, bins) if before is not None else self.spark.createDataFrame([], self.schema)
        merged = stays.join(new.select(*self.keys), self.keys, "left_anti").unionByName(new)
        return self.replace(stage(merged, "upsert-merged"), bins, version), bins

    def forget(self, keep: int = 2) -> None:
        """Remove manifests but for the newest ``keep``, and data folders that none of those names."""
        versions = self.versions()
        kept = versions[-keep:]
        held = set(kept)
        for v in kept:
            held |= {r["version"] for r in self.manifest(v).select("version").distinct().collect()}  # at most one per bin
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        system = path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for v in versions:
            if v not in kept:
                system.delete(path(f"{self.path}/manifest/version={v}"), True)
        for status in system.listStatus(path(f"{self.path}/data")) if kept else []:
            number = int(status.getPath().getName().split("=")[1])
            if number < kept[0] and number not in held:
                system.delete(status.getPath(), True)
