"""Nearest neighbours by a hash-prefix forest.

Every tree hashes a vector to a long string of bits, the signs of projections on random directions, and keeps the
strings in a sorted array. A query goes down each tree by binary search to its longest common prefix with any
string; then all trees go up together, one bit at a time, and give every vector that shares so long a prefix in
at least one of them, until enough distinct ones are found: a share of the block, and more than a result can hold.
A vector that many trees give counts once. These candidates are measured exactly, in double precision.

Vectors lie in blocks of bounded size, each with a forest of its own over all its vectors; the stated queries go to
every block in chunks of bounded size, and the nearest of all blocks are merged. Equal vectors are stored once with
their ``k + 1`` least ids, which is all that a result can hold of them, so copies neither fill the candidates nor
meet in one task.

Defined results: vectors that are null, zero, of another length than most, or that hold a null or non-finite
component take no part, neither as query nor as candidate. A query with fewer candidates gets them all. Ties go to
the smaller id. Repeated ids are one row for each vector they have; a query never finds its own id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusloom.llm.common import stage

#: Trees, bits of a hash string, and the share of a block that a query asks for as candidates.
TREES, BITS, SHARE = 128, 32, 0.5
#: Vectors of a block and queries of a chunk at the most (on average), and queries searched at a time.
BLOCK_ROWS, CHUNK_QUERIES, STEP_QUERIES = 16_384, 4_096, 64


class Forest:
    """Sorted arrays of hash strings over the rows of one block."""

    def __init__(self, vectors: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = 7):
        self.vectors = np.ascontiguousarray(vectors, dtype=np.float64)
        self.bits = bits
        random = np.random.default_rng(seed)
        self.planes = random.standard_normal((trees, self.vectors.shape[1], bits))
        self.middle = self.vectors.mean(axis=0) if len(self.vectors) else np.zeros(self.vectors.shape[1])
        self.order, self.codes = [], []
        for plane in self.planes:
            code = self._hash(self.vectors, plane)
            order = np.argsort(code, kind="stable").astype(np.int32)
            self.order.append(order)
            self.codes.append(code[order])

    def _hash(self, vectors: np.ndarray, plane: np.ndarray) -> np.ndarray:
        bit = ((vectors - self.middle) @ plane > 0).astype(np.uint64)
        return bit @ (np.uint64(1) << np.arange(self.bits - 1, -1, -1, dtype=np.uint64))

    def candidates(self, queries: np.ndarray, share: float, k: int) -> list[np.ndarray]:
        """Rows of the block for each query, after a synchronous ascent.

        A query is done when its distinct rows are ``share`` of the block and ``k + 1`` besides its own at least,
        and its trees gave the entries that this takes where they rarely repeat a row; or at the roots.
        """
        n = len(self.vectors)
        least = n if share >= 1 else min(n, max(k + 2, int(np.ceil(share * n))))
        enough = self.enough(share)
        hashed = [self._hash(queries, plane) for plane in self.planes]
        level = np.zeros(len(queries), dtype=np.int64)
        for code, own in zip(hashed, self.codes):  # down: the longest prefix shared with a neighbour in sorted order
            at = np.searchsorted(own, code)
            for side in (at - 1, at):
                x = own[np.clip(side, 0, len(own) - 1)] ^ code
                length = self.bits - np.ceil(np.log2(x.astype(np.float64) + 1)).astype(np.int64)
                level = np.maximum(level, length)
        low = np.zeros((len(self.codes), len(queries)), dtype=np.int64)
        high = low.copy()
        still = np.arange(len(queries))
        out: list[np.ndarray] = [np.empty(0, dtype=np.int64)] * len(queries)
        while len(still):  # up: all trees by one bit at a time
            shift = (self.bits - level[still]).astype(np.uint64)
            for t, (code, own) in enumerate(zip(hashed, self.codes)):
                first = code[still] >> shift << shift
                low[t, still] = np.searchsorted(own, first)
                high[t, still] = np.searchsorted(own, first + (np.uint64(1) << shift))
            found = (high[:, still] - low[:, still]).sum(axis=0)
            done = level[still] == 0
            for i in np.flatnonzero(done | (found >= enough)):  # repeats are told apart only where they may decide
                q = still[i]
                seen = np.zeros(n, dtype=bool)
                for t, order in enumerate(self.order):
                    seen[order[low[t, q]:high[t, q]]] = True
                out[q] = np.flatnonzero(seen)
                done[i] |= len(out[q]) >= least
            still = still[~done]
            level[still] -= 1
        return out

    def enough(self, share: float) -> int:
        """Entries that all trees together have to give at least: about ``share`` of the block as distinct rows
        where they rarely repeat, besides the query's own entry in each."""
        n = len(self.vectors)
        return len(self.codes) * n if share >= 1 else len(self.codes) + int(np.ceil(-np.log1p(-share) * n))

    def nearest(self, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Distances of rows to a query."""
        return np.sqrt(((self.vectors[rows] - query) ** 2).sum(axis=1))


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if column.num_chunks else pa.array([], type=pa.float64())
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _search(dim: int, k: int, share: float, trees: int):
    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        reps: list[int] = []
        ids: list[int] = []
        scores: list[float] = []
        if index.num_rows and queries.num_rows:
            forest = Forest(_matrix(index.column("vector"), dim), trees)
            members = index.column("ids").to_pylist()
            wanted = _matrix(queries.column("vector"), dim)
            names = queries.column("rep").to_pylist()
            for a in range(0, len(wanted), STEP_QUERIES):
                part = wanted[a:a + STEP_QUERIES]
                for q, rows in enumerate(forest.candidates(part, share, k)):
                    distance = forest.nearest(part[q], rows)
                    if len(rows) > k + 1:
                        cut = np.partition(distance, k)[k]
                        rows, distance = rows[distance <= cut], distance[distance <= cut]
                    best = sorted((d, i) for r, d in zip(rows.tolist(), distance.tolist()) for i in members[r])[:k + 1]
                    reps += [names[a + q]] * len(best)
                    scores += [d for d, _ in best]
                    ids += [i for _, i in best]
        return pa.table({"rep": pa.array(reps, pa.int64()), "vec_id": pa.array(ids, pa.int64()), "score": pa.array(scores, pa.float64())})
    return run


def usable(vector: str) -> Column:
    """Whether a vector can take part: finite components only, and not all of them zero."""
    return F.expr(f"coalesce(size(`{vector}`) > 0 AND forall(`{vector}`, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) "
                  f"AND exists(`{vector}`, x -> x <> 0), false)")


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding",
            share: float = SHARE, trees: int = TREES) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (Euclidean distance) of each query's k nearest found."""
    spark = vectors.sparkSession
    rows = vectors.filter(usable(vector)).filter(F.col(vec_id).isNotNull()).select(
        F.col(vec_id).cast("bigint").alias("id"), F.expr(f"transform(`{vector}`, x -> double(x) + 0.0D)").alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("asks"))
    lengths = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim = lengths["dim"] if lengths else 1
    rows = rows.filter(F.size("vector") == dim)
    # the k + 1 least ids of each distinct vector; Spark cuts each side of the shuffle to that many
    nth = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    kept = rows.select("vector", "id").distinct().withColumn("nth", nth).filter(F.col("nth") <= k + 1)
    classes = stage(kept.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("rep", F.element_at("ids", 1)), "vectors")
    asked = stage(rows.filter("asks").select(F.col("id").alias("query_id"), "vector").distinct()
                  .join(classes.select("vector", "rep"), "vector"), "queries")
    wanted = asked.select("rep", "vector").distinct()
    blocks = max(1, -(-classes.count() // BLOCK_ROWS))
    chunks = max(1, -(-wanted.count() // CHUNK_QUERIES))
    block = F.pmod(F.xxhash64("rep"), F.lit(blocks)).alias("block")
    chunk = F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(chunks)).alias("chunk")

    def every(n: int) -> Column:
        return F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))

    index = classes.select(block, F.explode(every(chunks)).alias("chunk"), "ids", "vector")
    queries = wanted.select(F.explode(every(blocks)).alias("block"), chunk, "rep", "vector")
    found = index.groupBy("block", "chunk").cogroup(queries.groupBy("block", "chunk")).applyInArrow(
        _search(dim, k, share, trees), "rep bigint, vec_id bigint, score double")
    best = found.withColumn("nth", F.row_number().over(Window.partitionBy("rep").orderBy("score", "vec_id"))).filter(F.col("nth") <= k + 1)
    best = best.drop("nth").join(asked.select("query_id", "rep"), "rep").filter("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")).cast("int")
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
