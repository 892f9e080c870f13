"""Near-duplicate documents by SuperMinHash signatures, banding, verification and union-find grouping.

1. Every whole text becomes its set of distinct word shingles and a signature (``superminhash``).
2. Documents with equal sets form one class, found by an aggregate; the class's least doc_id stands for it.
3. Classes that share the key of one band meet in a bucket. No bucket is expanded into its pairs: its members
   are held against one leader, and members that already hang together are not compared again. First the leader
   is the same in every band; then each bucket that still holds several groups takes a leader of its own, in
   ``ROUNDS`` rounds. Members of different groups that are still left in a bucket are compared in place, two
   blocks of about ``BLOCK`` members at a time, so that no task holds a whole bucket. Pairs come out to be
   verified unless a bitmap of their shingles proves them too different (an upper bound of the intersection, so
   it drops no link) or their signatures agree in less than ``AGREE`` of the slots (which befalls a pair at 0.8
   with a chance below 1e-7, by the binomial law of 240 slots). So any two members of a bucket are joined through confirmed links, or verified, or
   told apart by bitmap or signature.
4. A pair counts as linked when 100 * |A and B| >= percent * |A or B| on the full sets of both texts.
5. Links are grouped by ``components``.

Defined results: a null or wordless text has no shingles and is linked with nothing (component_id is its own
doc_id). A text shorter than a shingle is one shingle, the whole sequence. Repeated rows come out once each. Rows
without doc_id take part in nothing: component_id null, kept true. Rows that share a doc_id but not a text keep
their own classes; links of any of them count for the doc_id where it stands for a class.
Extra columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusloom.llm.common import partitions, small_batches, stage
from locusloom.llm.components import components
from locusloom.llm.superminhash import band_keys, signatures
from locusloom.llm.words import mix, shingle_sets

#: A pair at the threshold of 0.8 shares none of 40 bands of 6 slots with a chance of 5e-6.
BANDS, BAND_ROWS = 40, 6
#: Rounds in which a bucket of several groups is held against a leader of its own.
ROUNDS = 2

#: Share of equal slots from which a pair is verified in the end, nearly six standard errors below 0.8.
AGREE = 0.65
#: Cells of the bitmap of a set; those of sets with more shingles fill up and prove less.
CELLS = 4096
#: Members of a block of a bucket.
BLOCK = 1024

_FEATURES = "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, bands array<bigint>, slots binary"


def _features(width: int, bands: int, band_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column("text").to_pylist(), width)
            signature = signatures(sets, bands * band_rows)
            keys = band_keys(signature, bands)
            low = (signature & np.uint64(255)).astype(np.uint8)  # a byte of each slot is enough to compare
            with np.errstate(over="ignore"):
                a = [int(s.sum().view(np.int64)) if len(s) else 0 for s in sets]
                b = [int(np.bitwise_xor.reduce(mix(s + np.uint64(0x9E3779B97F4A7C15))).view(np.int64)) if len(s) else 0 for s in sets]
            flat = pa.array(keys.reshape(-1), type=pa.int64())
            offsets = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], type=pa.int64()),
                 pa.array(a, type=pa.int64()), pa.array(b, type=pa.int64()), pa.ListArray.from_arrays(offsets, flat),
                 pa.array([r.tobytes() for r in low], type=pa.binary())],
                names=["doc_id", "n_shingles", "set_a", "set_b", "bands", "slots"])
    return run


def _confirm(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            sets = shingle_sets(batch.column("text_a").to_pylist() + batch.column("text_b").to_pylist(), width)
            linked = []
            for x, y in zip(sets[:n], sets[n:]):
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= percent * (len(x) + len(y) - both) and both > 0)
            mask = pa.array(linked, type=pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])
    return run


def _cells(width: int):
    """Texts as bitmaps of their shingles: cell k is set if a shingle's hash begins with the bits of k."""
    shift = np.uint64(64 - CELLS.bit_length() + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column("text").to_pylist(), width)
            maps = []
            for s in sets:
                cells = np.zeros(CELLS, dtype=bool)
                cells[(s >> shift).astype(np.int64)] = True
                maps.append(np.packbits(cells).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array([len(s) for s in sets], type=pa.int64()), pa.array(maps, type=pa.binary())],
                names=["node", "n", "cells"])
    return run


def _alike(percent: int):
    """Pairs of members of two blocks of a bucket that are in different groups and may be linked; rows come by blocks."""
    def pairs(rows: list[tuple]) -> pd.DataFrame:
        lo, hi = rows[0][1:3]
        own, node, n, root = (np.array([r[k] for r in rows], dtype=np.int64) for k in (3, 4, 5, 6))
        slots = np.stack([np.frombuffer(r[7], dtype=np.uint8) for r in rows])
        cells = np.stack([np.frombuffer(r[8], dtype=np.uint64) for r in rows])
        hidden = n - np.bitwise_count(cells).sum(axis=1, dtype=np.int64)  # shingles that share a cell with another
        least = AGREE * slots.shape[1]
        second = np.flatnonzero(own == hi)
        found = [(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64))]
        for i in np.flatnonzero(own == lo):
            other = second[second > i] if lo == hi else second
            other = other[(root[other] != root[i]) & (100 * np.minimum(n[other], n[i]) >= percent * np.maximum(n[other], n[i]))]
            both = np.bitwise_count(cells[other] & cells[i]).sum(axis=1, dtype=np.int64) + np.minimum(hidden[other], hidden[i])
            other = other[(100 + percent) * both >= percent * (n[other] + n[i])]
            other = other[(slots[other] == slots[i]).sum(axis=1) >= least]
            found.append((np.full(len(other), i), other))
        a, b = (np.concatenate(x) for x in zip(*found))
        return pd.DataFrame({"a": node[a], "b": node[b], "na": n[a], "nb": n[b]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for batch in batches:
            for row in batch.itertuples(index=False, name=None):
                if held and held[0][:3] != row[:3]:
                    yield pairs(held)
                    held = []
                held.append(row)
        if held:
            yield pairs(held)
    return run


class _Buckets:
    """Rows (bucket, node, n): the buckets with more than one class, and the texts of their classes."""

    def __init__(self, docs: DataFrame, classes: DataFrame, width: int, percent: int):
        self.width, self.percent = width, percent
        rows = classes.select(F.explode("bands").alias("bucket"), F.col("rep").alias("node"), F.col("n_shingles").alias("n")).distinct()
        shared = rows.groupBy("bucket").agg(F.count("*").alias("many")).filter("many > 1").select("bucket")
        self.rows = stage(rows.join(shared, "bucket"), "buckets")
        nodes = self.rows.select(F.col("node").alias("doc_id")).distinct()
        self.texts = stage(docs.join(nodes, "doc_id", "leftsemi").select(F.col("doc_id").alias("node"), "text").distinct(), "texts")
        self.tested: DataFrame | None = None
        self.links: DataFrame | None = None

    def confirm(self, pairs: DataFrame) -> None:
        """Verify pairs (a, b, na, nb) that were not verified before; sizes too far apart can't be linked."""
        pairs = pairs.filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * self.percent)
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["a", "b"], "leftanti")
        pairs = stage(pairs, "pairs")
        with_a = pairs.join(self.texts.toDF("a", "text_a"), "a")
        with_both = with_a.join(self.texts.toDF("b", "text_b"), "b").select("a", "b", "text_a", "text_b")
        linked = stage(with_both.mapInArrow(_confirm(self.width, self.percent), "a bigint, b bigint"), "linked")
        self.tested = pairs if self.tested is None else self.tested.unionAll(pairs)
        self.links = linked if self.links is None else self.links.unionAll(linked)

    def against_leaders(self, rows: DataFrame, order: Column) -> DataFrame:
        """Pairs of a bucket's leader, the first in the given order, with its members of other groups."""
        leader = rows.groupBy("bucket").agg(F.min(F.struct(
            order.alias("o"), F.col("node").alias("b"), F.col("n").alias("nb"), F.col("root").alias("root_b"))).alias("l"))
        pairs = rows.join(leader.select("bucket", "l.b", "l.nb", "l.root_b"), "bucket").filter("root <> root_b")
        return pairs.select(F.col("node").alias("a"), "b", F.col("n").alias("na"), "nb")

    def unjoined(self) -> DataFrame:
        """Rows (bucket, node, n, root, many) of the buckets whose ``many`` members are not all in one component yet."""
        groups = components(self.links)
        rows = self.rows.join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
        open_ = rows.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("many"))
        return stage(rows.join(open_.filter("lo <> hi").select("bucket", "many"), "bucket"), "unjoined")

    def alike(self, signatures_: DataFrame) -> DataFrame:
        """Pairs of the members left in a bucket that bitmaps and signatures don't tell apart."""
        left = self.unjoined()
        texts = self.texts.join(left.select("node").distinct(), "node", "leftsemi")
        cells = stage(texts.mapInArrow(_cells(self.width), "node bigint, n bigint, cells binary"), "cells")
        left = left.withColumn("blocks", F.ceil(F.col("many") / BLOCK)).withColumn("own", F.pmod(F.xxhash64("node"), "blocks"))
        left = left.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
        left = left.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
        left = left.join(signatures_, ["node", "n"]).join(cells, ["node", "n"])
        left = left.select("bucket", "lo", "hi", "own", "node", "n", "root", "slots", "cells")
        blocks = ["bucket", "lo", "hi"]
        left = left.repartition(partitions(left.sparkSession), *blocks).sortWithinPartitions(*blocks, "node")
        return left.mapInPandas(_alike(self.percent), "a bigint, b bigint, na bigint, nb bigint")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, band_rows: int = BAND_ROWS) -> DataFrame:
    """(doc_id, text, ...) -> doc_id, n_shingles, component_id, kept; one row per input row."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    features = stage(docs.mapInArrow(_features(width, bands, band_rows), _FEATURES), "features")
    key = ["n_shingles", "set_a", "set_b"]
    known = features.filter("doc_id IS NOT NULL AND n_shingles > 0")
    reps = known.groupBy(*key).agg(F.min("doc_id").alias("rep"))
    classes = stage(known.join(reps.withColumnRenamed("rep", "doc_id"), [*key, "doc_id"], "leftsemi")
                    .select(F.col("doc_id").alias("rep"), "n_shingles", "bands", "slots"), "classes")
    buckets = _Buckets(docs, classes, width, percent)
    buckets.confirm(buckets.against_leaders(buckets.rows.withColumn("root", F.col("node")), F.xxhash64("node")))
    for turn in range(ROUNDS):
        buckets.confirm(buckets.against_leaders(buckets.unjoined(), F.xxhash64("node", "bucket", F.lit(turn))))
    buckets.confirm(buckets.alike(classes.select(F.col("rep").alias("node"), F.col("n_shingles").alias("n"), "slots").distinct()))
    groups = components(buckets.links).select(F.col("node").alias("rep"), "root")
    of_class = reps.join(groups, "rep", "left").select(*key, F.coalesce("root", "rep").alias("component_id"))
    rows = features.select("doc_id", *key).join(of_class, key, "left")
    rows = rows.withColumn("component_id", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("component_id")).otherwise(F.col("doc_id")))
    return rows.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each_group(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents that stay: the least doc_id of every group of near duplicates, one row each.

    Rows without doc_id stay. Of rows that repeat a kept doc_id one stays, the first by text and the other columns.
    """
    kept = near_duplicates(docs, width, percent).filter("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__kept")).distinct()
    rest = [F.col(c) for c in docs.columns if c != "doc_id" and dict(docs.dtypes)[c] != "map"]
    with_id = docs.join(kept, docs["doc_id"] == kept["__kept"], "leftsemi")
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(*rest))
    best = with_id.withColumn("__n", first).filter("__n = 1").select(*docs.columns)
    return best.unionAll(docs.filter("doc_id IS NULL"))
