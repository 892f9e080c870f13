"""Mixing sources to target weights by pivotal dependent rounding of fractional copies.

A source's target over its size is the number of copies that each of its documents should have, at most
``MOST_COPIES``. The whole part is given to every document; the fractions are settled by duels: two documents of a
source move words from one to the other, at random with the odds that keep every document's expectation, until one
of them has a whole number of copies. Words are kept in each duel, so a source's total doesn't drift. Documents
meet in bounded buckets of like size (a factor of two); what is left of each bucket, one document, meets the others
up a tree of ``FAN`` buckets a level. At the root one document of each size is left. They are settled from the
largest down, to the nearest whole copy, each handing what it could not take to the next smaller one, so a source
misses its target by a part of a small document.

Defined results: words are runs of anything but ASCII white space; null and empty texts have size 0 and are never
taken in (0 copies). Sources go by code point, null last. Ties go by hash of doc_id, doc_id and size. Random draws
come from doc_id and size alone, so reruns agree whatever the partitions. Repeated rows are rows of their own: rows of one
doc_id (or none), source and size are numbered and spread over the buckets by their number. A very long text is one large document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusloom.llm.common import WORD, partitions, ranked, stage
from locusloom.llm.words import mix

#: Weights by the rank of the source, repeating; and the most copies of a document.
WEIGHTS, MOST_COPIES = (1, 2, 3), 3
#: Rows of one source and size in a bucket, on average, and buckets that meet on each level of the tree.
BUCKET_ROWS, FAN = 2_000, 32
#: Equal rows that are numbered by one task.
RUN = 1024

_EDGE = 1e-9


def _size(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD)).cast("bigint")


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), _size(F.col("text")).alias("size"))


def numbered(groups: DataFrame) -> DataFrame:
    """Groups of equal rows (with their count n) as rows again, each with ``copy``, its number from 0. Groups above ``RUN`` rows
    are laid out in pieces by many tasks."""
    few = groups.filter(F.col("n") <= RUN).withColumn("copy", F.explode(F.expr("sequence(0L, n - 1)")))
    pieces = groups.filter(F.col("n") > RUN).withColumn("piece", F.explode(F.expr(f"sequence(0L, (n - 1) div {RUN})")))
    pieces = pieces.repartition(partitions(groups.sparkSession), "doc_id", "source", "size", "piece")
    many = pieces.withColumn("copy", F.explode(F.expr(f"sequence(piece * {RUN}, least(n, (piece + 1) * {RUN}) - 1)"))).drop("piece")
    return few.unionByName(many).drop("n")


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """rank, source, source_size, weight and target (words) for every source.

    The sources share all words by weight; one that would pass ``most`` times its size stops there and the excess
    is shared again among the others, until none is above. Only sums over sources reach the driver.
    """
    by_source = stage(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "source-sizes")
    order = [F.col("source").isNull().cast("int"), F.col("source")]
    by_source = ranked(by_source, order, "rank", "ranked-sources")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    by_source = by_source.withColumn("weight", F.get(cycle, (F.col("rank") % len(weights)).cast("int")))
    limit = F.col("source_size") * float(most)
    total = float(by_source.agg(F.sum("source_size")).first()[0] or 0)
    level, before = 0.0, -1  # words per unit of weight
    while True:
        full = by_source.agg(
            F.sum(F.when(limit <= level * F.col("weight"), limit).otherwise(0.0)).alias("held"),
            F.sum(F.when(limit <= level * F.col("weight"), 0.0).otherwise(F.col("weight"))).alias("weight"),
            F.count(F.when(limit <= level * F.col("weight"), True)).alias("n")).first()
        if full["n"] == before or not full["weight"]:
            break
        level, before = (total - full["held"]) / full["weight"], full["n"]
    return by_source.select("rank", "source", "source_size", "weight", F.least(limit, F.lit(level) * F.col("weight")).alias("target"))


def _uniform(ids: np.ndarray, sizes: np.ndarray, turn: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = mix(ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + sizes.astype(np.uint64) + np.uint64(turn * 0x1000003))
    return (x >> np.uint64(11)).astype(np.float64) / 2.0**53


_STATE = ["source_rank", "class", "bucket", "doc_id", "size", "whole", "part"]
_TYPES = "source_rank bigint, class int, bucket bigint, doc_id bigint, size bigint, whole int, part double"


def _settled(part: float) -> bool:
    return part < _EDGE or part > 1 - _EDGE


def _duels(turn: int):
    """Settle the rows of each (source, class, bucket) in order; they come sorted and may cross batches.

    Of each key at most one row comes out with a part that is neither 0 nor 1.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = held = None
        for batch in batches:
            draws = _uniform(batch["doc_id"].fillna(-1).to_numpy(), batch["size"].to_numpy(), turn).tolist()
            ids = batch["doc_id"].astype(object).where(batch["doc_id"].notna(), None)
            keys = zip(batch["source_rank"], batch["class"], batch["bucket"])
            out = []
            for k, doc, size, whole, part, u in zip(keys, ids, batch["size"], batch["whole"], batch["part"], draws):
                if k != key:
                    if held:
                        out.append((*key, *held))
                    key, held = k, None
                if _settled(part):
                    out.append((*k, doc, size, whole, round(part)))
                    continue
                if held is None:
                    held = (doc, size, whole, part)
                    continue
                doc0, size0, whole0, part0 = held
                up = min((1 - part0) * size0, part * size)  # words that the held one can take from the new one
                down = min(part0 * size0, (1 - part) * size)
                words = up if u * (up + down) < down else -down
                first, second = (doc0, size0, whole0, part0 + words / size0), (doc, size, whole, part - words / size)
                if not _settled(first[3]):
                    first, second = second, first
                out.append((*k, *first[:3], round(first[3])))
                held = second
                if _settled(held[3]):
                    out.append((*k, *held[:3], round(held[3])))
                    held = None
            yield _frame(out)
        if held:
            yield _frame([(*key, *held)])
    return run


def _frame(rows: list[tuple]) -> pd.DataFrame:
    made = pd.DataFrame(rows, columns=_STATE)
    return made.astype({"doc_id": "Int64", "part": "float64"})


def _root(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What is left of each source, at most one row per size class, from the largest down."""
    key, rest = None, 0.0
    for batch in batches:
        parts = []
        for source, size, whole, part in zip(batch["source_rank"], batch["size"], batch["whole"], batch["part"]):
            if source != key:
                key, rest = source, 0.0
            wanted = part + rest / size
            copies = min(max(round(wanted), -whole), MOST_COPIES - whole)
            rest = (wanted - copies) * size
            parts.append(float(copies))
        yield batch.assign(part=parts)


def mixed(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target and copies (0 to ``MOST_COPIES``) for every row."""
    spark = docs.sparkSession
    equal = sizes(docs).withColumn("doc_id", F.col("doc_id").cast("bigint")).groupBy("doc_id", "source", "size")
    groups = stage(equal.agg(F.count("*").alias("n")), "word-counts")
    sources = stage(targets(groups.select("source", (F.col("size") * F.col("n")).alias("size"))), "targets")
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    own = sources.select(F.col("source").alias("own"), "rank", share.alias("share"))
    buckets = max(1, -(-(groups.agg(F.sum("n")).first()[0] or 0) // BUCKET_ROWS))
    spread = F.when(F.col("copy") == 0, F.xxhash64("doc_id")).otherwise(F.xxhash64("doc_id", "copy"))
    # a source may be null and may hold a third of the rows; the other side has one row per source
    state = numbered(groups).join(own, F.col("source").eqNullSafe(F.col("own"))).select(
        F.col("rank").alias("source_rank"), F.floor(F.log2(F.greatest("size", F.lit(1)))).cast("int").alias("class"),
        F.pmod(spread, F.lit(buckets)).alias("bucket"), "doc_id", "size",
        F.when(F.col("size") > 0, F.floor(F.col("share") + _EDGE)).otherwise(0).cast("int").alias("whole"),
        F.when(F.col("size") > 0, F.greatest(F.lit(0.0), F.col("share") - F.floor(F.col("share") + _EDGE))).otherwise(0.0).alias("part"))
    done, turn = None, 0
    while True:
        dealt = state.repartition(partitions(spark), "source_rank", "class", "bucket")
        dealt = dealt.sortWithinPartitions("source_rank", "class", "bucket", F.xxhash64("doc_id", "size"), "doc_id", "size")
        made = stage(dealt.mapInPandas(_duels(turn), _TYPES), "duels")
        settled = made.filter("part = 0 OR part = 1")
        done = settled if done is None else done.unionAll(settled)
        state = made.filter("part <> 0 AND part <> 1")
        if buckets == 1:
            break
        buckets, turn = -(-buckets // FAN), turn + 1
        state = state.withColumn("bucket", F.floor(F.col("bucket") / FAN))
    last = state.repartition(partitions(spark), "source_rank").sortWithinPartitions("source_rank", F.desc("class"), "size", "doc_id")
    done = done.unionAll(last.mapInPandas(_root, _TYPES))
    copies = done.select("doc_id", "size", F.col("source_rank").alias("rank"), (F.col("whole") + F.col("part")).cast("int").alias("copies"))
    return copies.join(sources, "rank").select("doc_id", "source", "size", "source_size", "target", "copies")


def mixture(docs: DataFrame) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with all columns of ``docs``.

    Rows that share doc_id, source and size share their copies, earlier texts first.
    """
    per_key = mixed(docs).groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    key = [F.col("doc_id").cast("bigint"), F.col("source").cast("string"), _size(F.col("text"))]
    rows = docs.select(F.struct(*docs.columns).alias("row"), *[k.alias(n) for k, n in zip(key, ("k1", "k2", "k3"))])
    same = F.col("k1").eqNullSafe(F.col("doc_id")) & F.col("k2").eqNullSafe(F.col("source")) & (F.col("k3") == F.col("size"))
    joined = rows.join(per_key, same)
    nth = F.row_number().over(Window.partitionBy("k1", "k2", "k3").orderBy(F.col("row.text")))
    own = F.floor(F.col("copies") / F.col("rows")) + (nth <= F.col("copies") % F.col("rows")).cast("int")
    repeated = joined.select("row", own.cast("int").alias("n")).filter("n > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return repeated.select("row.*")
