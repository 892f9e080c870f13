"""Sharding by fixed virtual slots and a versioned map from slots to shards.

A record's slot is a hash of its doc_id, its text and its number among equal records, one of thousands. Bytes are summed per slot; only these sums
(one row per slot, a fixed number) reach the driver, which lays out the map: the heaviest slots first, each to the
lightest shard. The map is a table of its own with a version; ``rebalanced`` edits a stored map (it moves as few
slots as it must, also when shards are added) and writes the next version. Rows are never moved by hand: a row's
shard is its slot's entry in the version that is read.

Defined results: a null text has no bytes and size 1; a null doc_id is hashed as such, with its text; repeated rows
(one doc_id or none, one text) are numbered from 0 and spread over the slots by their number, so that no slot fills up. An empty table gives a map with empty slots and no rows.
A slot is the least that can move, so one record above a shard's fair share makes its shard as heavy as itself.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusloom.llm.common import partitions, stage

#: Virtual slots. The number is fixed for the life of a map; it bounds what the driver holds and the map's broadcast.
SLOTS = 8192
SHARDS = 16
#: Equal rows that are numbered together.
RUN = 1024

_MAP = "version int, slot int, shard int, bytes bigint"


def slot_of(slots: int = SLOTS) -> Column:
    """The virtual slot of a row with doc_id, text_crc32 and copy."""
    key = [F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_crc32")]
    hashed = F.when(F.col("copy") == 0, F.xxhash64(*key)).otherwise(F.xxhash64(*key, F.col("copy")))
    return F.pmod(hashed, F.lit(slots)).cast("int")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes and 1), text_crc32 and copy (a number from 0 among equal rows) of every row; texts
    go no further than this. Equal rows are counted, and given out again in runs of ``RUN`` by many tasks."""
    text = F.col("text").cast("string")
    rows = docs.select(
        "doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"))
    key = ["doc_id", "size", "text_crc32"]
    runs = rows.groupBy(*key).agg(F.count("*").alias("n")).withColumn("run", F.explode(F.expr(f"sequence(0L, (n - 1) div {RUN})")))
    runs = runs.repartition(partitions(docs.sparkSession), *key, "run")
    return runs.select(*key, F.explode(F.expr(f"sequence(run * {RUN}, least(n, (run + 1) * {RUN}) - 1)")).alias("copy"))


def slot_bytes(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    return rows.groupBy(slot_of(slots).alias("slot")).agg(F.sum("size").alias("bytes"))


def _table(spark: SparkSession, version: int, shard_of: list[int], size: list[int]) -> DataFrame:
    return spark.createDataFrame([(version, i, s, size[i]) for i, s in enumerate(shard_of)], _MAP)


def _sums(sums: DataFrame, slots: int) -> list[int]:
    size = [0] * slots
    for r in sums.collect():  # at most one row per slot
        size[r["slot"]] = r["bytes"]
    return size


def first_map(sums: DataFrame, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Version 1: the heaviest slot goes to the lightest shard, and so on; empty slots go round."""
    size = _sums(sums, slots)
    load = [(0, s) for s in range(shards)]
    shard_of = [i % shards for i in range(slots)]
    for i in sorted(range(slots), key=lambda i: (-size[i], i)):
        if size[i]:
            have, s = heapq.heappop(load)
            shard_of[i] = s
            heapq.heappush(load, (have + size[i], s))
    return _table(sums.sparkSession, 1, shard_of, size)


def rebalanced(old: DataFrame, sums: DataFrame, shards: int, slack: float = 0.01) -> DataFrame:
    """The next version of a map for new sums or a new number of shards: slots leave a shard only while it is
    above its fair share by more than ``slack``, or when the shard is gone, and go to the lightest one."""
    rows = old.orderBy("slot").collect()  # one row per slot
    size = _sums(sums, len(rows))
    shard_of = [r["shard"] for r in rows]
    load = [0] * shards
    for i, s in enumerate(shard_of):
        if s < shards:
            load[s] += size[i]
    fair = sum(size) / shards
    homeless = [i for i, s in enumerate(shard_of) if s >= shards]
    for s in range(shards):
        own = sorted((i for i, t in enumerate(shard_of) if t == s and size[i]), key=lambda i: (size[i], i))
        while load[s] > fair * (1 + slack) and own and load[s] - size[own[0]] >= fair * (1 - slack):
            i = own.pop(0)
            load[s] -= size[i]
            homeless.append(i)
    heap = [(n, s) for s, n in enumerate(load)]
    heapq.heapify(heap)
    for i in sorted(homeless, key=lambda i: (-size[i], i)):
        have, s = heapq.heappop(heap)
        shard_of[i] = s
        heapq.heappush(heap, (have + size[i], s))
    version = (rows[0]["version"] if rows else 0) + 1
    return _table(old.sparkSession, version, shard_of, size)


def placed(rows: DataFrame, slot_map: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Add ``shard``, ``virtual_slot`` and ``slot``: the row's place in its shard, from 0 without gaps.

    Rows are numbered within their virtual slot (a window over one of thousands of slots), which starts at the
    sum of the rows of the shard's earlier slots. The map has one row per slot, so it may be broadcast.
    """
    kept = stage(rows.withColumn("virtual_slot", slot_of(slots)), "sized")
    counts = kept.groupBy("virtual_slot").agg(F.count("*").alias("n"))
    starts = slot_map.select(F.col("slot").alias("virtual_slot"), "shard").join(counts, "virtual_slot", "left")
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("virtual_slot", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size", "copy")) - 1
    numbered = kept.withColumn("within", within).join(F.broadcast(starts), "virtual_slot")
    return numbered.withColumn("slot", (F.col("start") + F.col("within")).cast("bigint"))


def shards(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """The placed rows and the stored map, version 1."""
    rows = stage(sized(docs), "sizes")
    slot_map = stage(first_map(slot_bytes(rows, slots), shards, slots), "slot-map")
    return placed(rows, slot_map, slots), slot_map
