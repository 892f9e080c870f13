"""Document fingerprints from prefix polynomial hashes.

A text's prefix arrays hold, for two bases, the polynomial of its first i code points modulo 2^31 - 1. The hash of
any span follows from two entries in constant time, whatever the place; equal spans have equal hashes, and the
longest common extension of two places is found by binary search over span hashes.

A fingerprint is the hash of the whole text with its length, and the ``SKETCH`` least mixed hashes of all its spans
of ``SPAN`` code points. Likeness is read from two fingerprints alone: the share of common values among the least
ones of both, an estimate of how many of the distinct spans two texts share.

Defined results: a null text is empty. A text shorter than a span is one span. Two empty texts are alike (1); an
empty and a non-empty one are not (0). Equal texts have equal fingerprints.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusloom.llm.common import partitions, small_batches
from locusloom.llm.words import mix

PRIME = np.uint64(2**31 - 1)
BASES = (1_000_003_931 % (2**31 - 1), 1_640_531_527)
SPAN, SKETCH = 16, 64
#: Code points hashed at a time; longer texts are cut into overlapping parts for the sketch.
PART = 1 << 20


def _fold(x: np.ndarray) -> np.ndarray:
    """A smaller number that is x modulo 2^31 - 1: below 2^33 + 2^31 for any x, below 2^31 + 8 the second time."""
    return (x & PRIME) + (x >> np.uint64(31))


def _reduce(x: np.ndarray) -> np.ndarray:
    """x modulo 2^31 - 1."""
    x = _fold(_fold(_fold(x)))
    return np.where(x >= PRIME, x - PRIME, x)


_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base, np.ones(1, dtype=np.uint64))
    while len(have) < n:
        have = np.concatenate([have, _reduce(have * np.uint64(pow(base, len(have), int(PRIME))))])
    _powers[base] = have
    return have[:n]


def code_points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class PrefixHashes:
    """Prefix arrays of one text (or one part of a long one)."""

    def __init__(self, text: str | None | np.ndarray):
        points = text if isinstance(text, np.ndarray) else code_points(text)
        self.n = len(points)
        values = points.astype(np.uint64) + np.uint64(1)
        self.sums = []
        for base in BASES:
            sums = np.zeros(self.n + 1, dtype=np.uint64)
            np.cumsum(_fold(_fold(values * _power(base, self.n))), out=sums[1:])  # below 2^64 for texts below 2^32
            self.sums.append(_fold(_fold(sums)))

    def spans(self, size: int) -> np.ndarray:
        """The hash of every span of a size, in order of place."""
        if size > self.n:
            return np.empty(0, dtype=np.uint64)
        out = None
        for base, sums in zip(BASES, self.sums):
            inverse = pow(base, -1, int(PRIME))
            between = _fold(sums[size:] + np.uint64(4) * PRIME - sums[:self.n - size + 1])
            own = _reduce(between * _power(inverse, self.n - size + 1))
            out = own if out is None else (out << np.uint64(31)) | own
        return out

    def span(self, start: int, end: int) -> int:
        """The hash of one span, from two entries of each array."""
        out = 0
        for base, sums in zip(BASES, self.sums):
            own = (int(sums[end]) - int(sums[start])) * pow(pow(base, -1, int(PRIME)), start, int(PRIME)) % int(PRIME)
            out = out << 31 | own
        return out

    def equal(self, start: int, other: PrefixHashes, other_start: int, size: int) -> bool:
        return (start + size <= self.n and other_start + size <= other.n
                and self.span(start, start + size) == other.span(other_start, other_start + size))

    def common_extension(self, start: int, other: PrefixHashes, other_start: int) -> int:
        """Length of the longest common extension of two places, by binary search."""
        low, high = 0, min(self.n - start, other.n - other_start)
        while low < high:
            middle = (low + high + 1) // 2
            if self.equal(start, other, other_start, middle):
                low = middle
            else:
                high = middle - 1
        return low


def _mixed(spans: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(spans) >> np.uint64(32)).astype(np.uint32)


def _least(values: np.ndarray) -> np.ndarray:
    """The ``SKETCH`` least distinct values."""
    if len(values) > 8 * SKETCH:
        few = np.unique(values[values <= np.partition(values, 4 * SKETCH)[4 * SKETCH]])
        if len(few) >= SKETCH:  # else a text repeats itself, and all values are needed
            return few[:SKETCH]
    return np.unique(values)[:SKETCH]


def _print(whole: int, n: int, least: np.ndarray) -> str:
    """Whole hash and length in hex, then the sketch, 8 digits a value."""
    return f"{whole:016x}{n:010x}" + least.astype(">u4").tobytes().hex()


class Text:
    """One text with its prefix arrays, the mixed values of its spans, and its fingerprint."""

    def __init__(self, points: np.ndarray):
        self.points, self.n = points, len(points)
        self.prefix = self.values = None
        if self.n <= PART:
            self.prefix = PrefixHashes(points)
            self.values = _mixed(self.prefix.spans(SPAN))
            short = 0 < self.n < SPAN
            self.print = _print(self.prefix.span(0, self.n), self.n, _least(_mixed(self.prefix.spans(self.n)) if short else self.values))
            return
        whole, kept = 0, np.empty(0, dtype=np.uint32)
        for start in range(0, self.n, PART):
            own = PrefixHashes(points[start:start + PART])
            whole = (whole * 0x9E3779B97F4A7C15 + own.span(0, own.n)) % 2**62
            kept = _least(np.concatenate([kept, _mixed(PrefixHashes(points[start:start + PART + SPAN - 1]).spans(SPAN))]))
        self.print = _print(whole, self.n, kept)

    def joined_print(self, keep: int, other: Text, take: int, joined: np.ndarray) -> str:
        """Fingerprint of the first ``keep`` code points with the first ``take`` of another text after them.

        Spans on either side of the seam keep the values that they have in their own text.
        """
        if not SPAN <= keep + take <= PART or self.prefix is None or other.prefix is None:
            return Text(joined).print
        seam = PrefixHashes(joined[max(0, keep - SPAN + 1):keep + SPAN - 1])
        values = np.concatenate([self.values[:max(0, keep - SPAN + 1)], _mixed(seam.spans(SPAN)), other.values[:max(0, take - SPAN + 1)]])
        whole = 0
        for base, own, rest in zip(BASES, self.prefix.sums, other.prefix.sums):
            whole = whole << 31 | (int(own[keep]) + pow(base, keep, int(PRIME)) * int(rest[take])) % int(PRIME)
        return _print(whole, len(joined), _least(values))


def fingerprint(text: str | None) -> str:
    return Text(code_points(text)).print


def likeness(a: str, b: str) -> float:
    """Estimated share of distinct spans that two texts have in common, from their fingerprints."""
    if a == b:
        return 1.0
    x, y = ({f[i:i + 8] for i in range(26, len(f), 8)} for f in (a, b))
    union = sorted(x | y)[:SKETCH]
    return sum(v in x and v in y for v in union) / len(union) if union else 1.0


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """Add the fingerprint of every text."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t) for t in texts], dtype=object)

    return docs.withColumn(name, run(F.col(text).cast("string")))


def _in_order(docs: DataFrame) -> DataFrame:
    """Rows (bucket, extra, doc_id, text), sorted within partitions by descending doc_id, every bucket followed by
    the first row of the next one (marked ``extra``), so that each row finds the next one right after it.

    Buckets are ranges of doc_id between quantiles; only those limits and one doc_id per bucket are collected.
    """
    spark = docs.sparkSession
    n = partitions(spark) * 4
    rows = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cuts = sorted({int(c) for c in rows.select("doc_id").approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n)}, reverse=True)
    limits = F.array(*[F.lit(c).cast("bigint") for c in cuts])
    bucket = F.size(F.filter(limits, lambda c: c > F.col("doc_id"))).cast("int")
    rows = rows.withColumn("bucket", bucket)
    firsts = sorted((r["bucket"], r["first"]) for r in rows.groupBy("bucket").agg(F.max("doc_id").alias("first")).collect())
    before = {first: firsts[i - 1][0] for i, (_, first) in enumerate(firsts)}
    pairs = spark.createDataFrame([(k, v) for k, v in before.items()], "doc_id bigint, before int")  # a row per bucket
    extra = rows.drop("bucket").join(F.broadcast(pairs), "doc_id").select(F.col("before").alias("bucket"), F.lit(True).alias("extra"), "doc_id", "text")
    both = rows.select("bucket", F.lit(False).alias("extra"), "doc_id", "text").unionAll(extra)
    return both.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket", "extra", F.desc("doc_id"), F.crc32("text"), "text")


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held = None
    for batch in batches:
        out = []
        for extra, doc, text in zip(batch["extra"], batch["doc_id"], batch["text"]):
            if extra and held is None:
                continue  # a further copy of the next bucket's first row
            own = Text(code_points(text))
            if held is not None:
                out.append(_row(*held, own))
            held = None if extra else (doc, own)
        yield pd.DataFrame(out, columns=_COLUMNS)


def _row(doc: int | None, own: Text, following: Text) -> tuple:
    half = own.n // 2
    keep, take = own.n - half, min(half, following.n)
    edited = np.concatenate([own.points[:keep], following.points[:take]])
    edited_print = own.joined_print(keep, following, take, edited)
    digest = hashlib.sha256(edited.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")).hexdigest()
    return doc, own.n, digest, own.print, edited_print, likeness(own.print, edited_print), likeness(own.print, following.print)


_SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_COLUMNS = [c.split()[0] for c in _SCHEMA.split(", ")]


def _alone(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    empty = Text(code_points(""))
    for batch in batches:
        rows = [_row(None, Text(code_points(t)), empty) for t in batch["text"]]
        yield pd.DataFrame(rows, columns=_COLUMNS).astype({"doc_id": "Int64"})


def edited_neighbours(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside that of its edited text and of the next document, by descending doc_id.

    The last floor(n_chars / 2) code points are replaced by the first as many of the next document; the last
    document is followed by the first. Rows that repeat a doc_id follow each other by their texts. Rows without
    doc_id follow none: they are edited with an empty text and are nobody's next.
    """
    small_batches(docs.sparkSession)
    chained = _in_order(docs).mapInPandas(_compare, _SCHEMA)
    without = docs.filter("doc_id IS NULL").select(F.col("text").cast("string").alias("text"))
    return chained.unionAll(without.mapInPandas(_alone, _SCHEMA))
