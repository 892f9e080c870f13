"""Line dedup over levelled sorted runs of line hashes.

Documents come in batches in the order of doc_id. A store holds the hashes of all line keys seen so far, each with the least
doc_id that holds it, as sorted runs: tables in buckets of the key, sorted by it, on levels. A new batch is merged with the
runs (no run is shuffled: a bucket meets its own), keys found in none form the batch's own run on level 0, and a level with
``FANOUT`` runs is compacted into one run of the next level, so a key is rewritten once per level. A line goes if its key's least
document is another one than its own: a run's, or the first in the batch.

Everything is DataFrame functions. Lines are two 64-bit hashes and a place; texts are read twice (hashes, then cutting) and
shuffled once. Keys are counted before they meet lines: those with over a thousandth of a batch's lines (so 1,000 at the
most) are broadcast, and all others are shuffled, so no key fills a task.

Defined results: a null text is empty, and an empty text is one empty line. Lines are parted by \\n alone. Only keys of ``SHORTEST`` code
points or more count. Rows of one doc_id are one document; rows of the least one keep their lines, however often they stand.
A null doc_id is one document after all others. Rows that repeat as a whole give repeated results. A very long text is
one row; its places are cut in one go over its lines. An empty table gives no rows. Other columns are kept, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusloom.llm.common import stage, staged_path

#: Code points of the shortest key that counts.
SHORTEST = 10
#: Runs on one level before they are compacted.
FANOUT = 2
#: Batches that a table of documents is taken in.
BATCHES = 4
#: A key with more than 1 / HOT of a batch's lines is broadcast.
HOT = 1000

_SPACE = "' \\t\\n\\u000b\\f\\r'"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The key of a line x; texts of ASCII alone may take the faster lower-casing, which is the same there.
_KEY = f"btrim(IF(octet_length(x) = char_length(x), lower(x), translate(x, '{_UPPER}', '{_UPPER.lower()}')), {_SPACE})"
_HASHES = ["h1", "h2"]


def _body() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def hashed_lines(docs: DataFrame) -> DataFrame:
    """doc_id, print (hash of the whole text), at (line number from 0), h1, h2 of every line whose key counts."""
    rows = docs.select("doc_id", F.xxhash64(_body()).alias("print"), F.split(_body(), "\n").alias("lines"))
    keys = rows.select("doc_id", "print", F.posexplode(F.expr(f"transform(lines, x -> {_KEY})")).alias("at", "key"))
    counted = keys.filter(F.char_length("key") >= SHORTEST)
    return counted.select("doc_id", "print", "at", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))


class LineRuns:
    """The store: levels of sorted runs, each a bucketed table of h1, h2 and first (least doc_id, or null)."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def _write(self, df: DataFrame) -> str:
        """A table of its own in the shared folder: one sorted file per bucket, as df is dealt by the same hash."""
        name = f"line_run_{uuid.uuid4().hex}"
        path = staged_path(self.spark, name)
        df.write.bucketBy(self.buckets, *_HASHES).sortBy(*_HASHES).option("path", path).saveAsTable(name)
        return name

    def _forget(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def run(self, name: str) -> DataFrame:
        return self.spark.table(name).filter("fresh").select(*_HASHES, "first")

    def runs(self) -> list[DataFrame]:
        return [self.run(name) for level in reversed(self.levels) for name in level]

    def _compact(self) -> None:
        """Make room on level 0: a full level becomes one run of the next. Keys stand in one run only, so runs are joined end to end."""
        for i in range(len(self.levels)):
            if len(self.levels[i]) < self.fanout:
                break
            if i + 1 == len(self.levels):
                self.levels.append([])
            merged = self.run(self.levels[i][0])
            for name in self.levels[i][1:]:
                merged = merged.unionAll(self.run(name))
            merged = merged.repartition(self.buckets, *_HASHES).select(*_HASHES, "first", F.lit(True).alias("fresh"))
            made = self._write(merged)
            for name in self.levels[i]:
                self._forget(name)
            self.levels[i] = []
            self.levels[i + 1].append(made)

    def add(self, lines: DataFrame) -> DataFrame:
        """Take in a batch of hashed lines, later in doc_id than all before, and return those that go."""
        self._compact()
        null = F.col("doc_id").isNull()
        own = lines.groupBy(*_HASHES).agg(
            F.min("doc_id").alias("own"), F.max("doc_id").alias("last"), F.max(null).alias("nulls"), F.count("*").alias("lines"))
        known = F.lit(None)
        for k, run in enumerate(self.runs()):
            held = run.select(*_HASHES, F.struct("first").alias(f"run{k}"))
            own = own.join(held.hint("merge"), _HASHES, "left")
            known = F.coalesce(known, F.col(f"run{k}")) if k else F.col("run0")
        fresh = known.isNull() if self.levels else F.lit(True)
        first = F.when(fresh, F.col("own")).otherwise(known.getField("first")) if self.levels else F.col("own")
        own = own.withColumns({"first": first, "fresh": fresh})
        shared = F.col("first").isNotNull() & ((F.col("last") > F.col("first")) | F.col("nulls"))
        keys = self._write(own.select(*_HASHES, "first", "fresh", shared.alias("shared"), "lines"))
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(keys)
        return self._going(lines, self.spark.table(keys))

    def _going(self, lines: DataFrame, keys: DataFrame) -> DataFrame:
        total = keys.agg(F.sum("lines")).first()[0] or 0  # one number
        often = F.col("lines") * HOT > total
        shared = keys.filter("shared").select(*_HASHES, "first", "lines")
        hot = F.broadcast(shared.filter(often).select(*_HASHES, "first"))  # fewer than HOT rows
        rest = lines.join(hot, _HASHES, "left_anti")
        found = lines.join(hot, _HASHES).unionByName(rest.join(shared.filter(~often).select(*_HASHES, "first").hint("merge"), _HASHES))
        return found.filter(F.col("doc_id").isNull() | (F.col("doc_id") > F.col("first"))).select("doc_id", "print", "at")

    def close(self) -> None:
        for level in self.levels:
            for name in level:
                self._forget(name)
        self.levels = []


def _cuts(docs: DataFrame, batches: int) -> list[int]:
    at = ", ".join(str(i / batches) for i in range(1, batches))
    found = docs.agg(F.expr(f"percentile_approx(doc_id, array({at}))")).first()[0] if batches > 1 else []  # batches - 1 numbers
    return sorted(set(found or []))


def going_lines(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """doc_id, print and at of every line that another, earlier document holds: batches of near equal numbers of rows in order of doc_id."""
    cuts = _cuts(docs, batches)
    batch = sum((F.when(F.col("doc_id") <= c, 0).otherwise(1) for c in cuts), F.lit(0))  # a null doc_id is in the last one
    lines = stage(hashed_lines(docs).withColumn("batch", batch.cast("int")), "line-hashes", ["batch"])
    store, going = LineRuns(docs.sparkSession), None
    for i in range(len(cuts) + 1):
        found = stage(store.add(lines.filter(F.col("batch") == i).drop("batch")), "going-lines")
        going = found if going is None else going.unionAll(found)
    store.close()
    return going


def deduplicated(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """All rows and columns; ``text`` without the lines that go, n_lines (before) and n_dropped besides."""
    going = going_lines(docs, batches)
    cut = going.groupBy(F.col("doc_id").alias("__doc"), F.col("print").alias("__print")).agg(
        F.sort_array(F.collect_set("at")).alias("__cut"))
    rows = docs.withColumn("__own", F.xxhash64(_body()))
    rows = rows.join(cut, rows["doc_id"].eqNullSafe(cut["__doc"]) & (rows["__own"] == cut["__print"]), "left")
    rows = rows.withColumn("__lines", F.split(_body(), "\n"))
    pieces = """transform(sequence(0, size(__cut)), i -> struct(
        IF(i = 0, 0, __cut[i - 1] + 1) AS a, IF(i = size(__cut), size(__lines), __cut[i]) AS b))"""
    kept = f"array_join(flatten(transform({pieces}, p -> slice(__lines, p.a + 1, p.b - p.a))), '\\n')"
    return rows.select(
        *[F.col(c) for c in docs.columns if c not in ("text", "n_lines", "n_dropped")],
        F.when(F.col("__cut").isNull(), _body()).otherwise(F.expr(kept)).alias("text"),
        F.size("__lines").cast("bigint").alias("n_lines"), F.coalesce(F.size("__cut"), F.lit(0)).cast("bigint").alias("n_dropped"))
