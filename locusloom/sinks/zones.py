"""Tables sorted by place with an index of each file's range: regions open only the files they meet, pages go on from a cursor.

Rows are dealt to ranges of place, sorted, and numbered in that order (``_row``: growing through all files, with gaps). The index has one
row per file: its first and last place, its first and last number and its number of rows. A page is asked for with the last number of the
page before it, so its cost depends on neither its own number nor the size of the table, and rows that share a place are never
lost or repeated between pages.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusloom.session import stage
from locusloom.sinks.ranges import in_ranges, place_keys

ROW = "_row"
_INDEX = "file string, first_place bigint, last_place bigint, first_row bigint, last_row bigint, rows bigint"
#: Rows of one file, at most.
FILE_ROWS = 2_000_000


def _place(chromosome: Column | int, position: Column | int) -> Column:
    """Chromosome and position in one number, in their order."""
    chromosome, position = (c if isinstance(c, Column) else F.lit(c) for c in (chromosome, position))
    return F.shiftleft(chromosome.cast("bigint"), 40) + position.cast("bigint")


def _inside(chromosome: int, start: int, end: int) -> Column:
    return (F.col("chromosome") == chromosome) & F.col("position").between(start, end)


class ZoneTable:
    """A table with ``chromosome`` (int), ``position`` and further columns below a path.

    Rows without chromosome or position are kept: they have no place, so regions and pages don't show them.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, df: DataFrame, order: list[str] | None = None, file_rows: int = FILE_ROWS) -> None:
        """Write rows sorted by place, then ``order`` (by default alleles and identifier, as far as there are any), and the index."""
        keys = place_keys(df) if order is None else ["chromosome", "position", *order]
        rows = stage(df, "zone-rows")  # read twice: the bounds of the ranges are sampled
        # Numbers grow with the range and inside it.
        dealt = in_ranges(rows, keys).withColumn(ROW, F.monotonically_increasing_id())
        dealt.write.mode("overwrite").option("maxRecordsPerFile", file_rows).parquet(f"{self.path}/data")
        place = _place(F.col("chromosome"), F.col("position"))
        written = self.spark.read.schema(dealt.schema).parquet(f"{self.path}/data")
        index = written.select(F.col("_metadata.file_name").alias("file"), place.alias("_p"), ROW).groupBy("file").agg(
            F.min("_p").alias("first_place"), F.max("_p").alias("last_place"), F.min(ROW).alias("first_row"), F.max(ROW).alias("last_row"),
            F.count("*").alias("rows"))
        index.write.mode("overwrite").parquet(f"{self.path}/index")
        self._schema = dealt.schema

    @property
    def schema(self):
        if not hasattr(self, "_schema"):
            self._schema = self.spark.read.parquet(f"{self.path}/data").schema
        return self._schema

    def index(self) -> DataFrame:
        return self.spark.read.schema(_INDEX).parquet(f"{self.path}/index")

    def files(self, regions: list[tuple[int, int, int]], after: int | None = None) -> list:
        """Index rows of the files that any of the regions meets, in order; with a cursor, of those with later rows."""
        if not regions:
            return []
        meets = reduce(Column.__or__, [(F.col("first_place") <= _place(c, e)) & (F.col("last_place") >= _place(c, s)) for c, s, e in regions])
        found = self.index().filter(meets)
        if after is not None:
            found = found.filter(F.col("last_row") > after)
        return found.orderBy("first_row").collect()  # one row a file, of those that are then opened

    def _open(self, files: list) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{f.file}" for f in files])

    def regions(self, regions: list[tuple[int, int, int]]) -> DataFrame:
        """Rows of any of some (chromosome, start, end), ends included, each row once."""
        rows = self._open(self.files(regions))
        inside = reduce(Column.__or__, [_inside(*r) for r in regions], F.lit(False))
        return rows.filter(inside).drop(ROW)

    def region(self, chromosome: int, start: int, end: int) -> DataFrame:
        return self.regions([(chromosome, start, end)])

    def region_count(self, chromosome: int, start: int, end: int) -> int:
        """Rows of a region: files inside it are counted by the index, only those at its ends are opened."""
        lowest, highest = (chromosome << 40) + start, (chromosome << 40) + end
        found = self.files([(chromosome, start, end)])
        whole = [f for f in found if lowest <= f.first_place and f.last_place <= highest and f.first_place <= f.last_place]
        # A file may hold rows without a place, which lie first in the order and are counted by no region.
        whole = [f for f in whole if f.first_row != 0]
        rest = [f for f in found if f not in whole]
        counted = sum(f.rows for f in whole)
        return counted + (self._open(rest).filter(_inside(chromosome, start, end)).count() if rest else 0)

    def page(
        self, chromosome: int, start: int, end: int, size: int = 100, after: int | None = None, keep: Column | None = None,
    ) -> tuple[DataFrame, int | None]:
        """The next ``size`` rows of a region that pass ``keep``, and the cursor of the page after it (None: there is none).

        Files are opened from the cursor on, twice as many each time, until the page is full.
        """
        found = self.files([(chromosome, start, end)], after)
        wanted = _inside(chromosome, start, end) if keep is None else _inside(chromosome, start, end) & keep
        if after is not None:
            wanted = wanted & (F.col(ROW) > after)
        opened = 1
        while True:
            # One row more than the page tells whether another page follows.
            rows = self._open(found[:opened]).filter(wanted).orderBy(ROW).limit(size + 1)
            numbers = [r[0] for r in rows.select(ROW).collect()]  # of one page
            if len(numbers) > size or opened >= len(found):
                break
            opened *= 2
        page = rows.filter(F.col(ROW) <= numbers[size - 1]) if len(numbers) > size else rows
        return page.drop(ROW), numbers[size - 1] if len(numbers) > size else None
