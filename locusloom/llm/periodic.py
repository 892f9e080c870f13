"""Periodic runs of words, by recursive frequency splitting and lag scans.

A run is a stretch of words with smallest period q (words q apart are the same) of at least ``max(LEAST, 2 q)`` words that
no neighbouring word extends. Every word of a run stands in it again at distance q, which is at most half of the run. So
within a segment, a word that stands there once, or whose next of its kind is further away than half of the segment, joins no run
and splits the segment; what is left of it is looked at again until nothing splits any more. Segments below ``LEAST`` words hold
no run. In each segment that survives, every lag up to half of it is scanned: words q apart must agree over at least q words on end, so
looking at every q-th word finds each such stretch, and only stretches found are followed to both ends. A segment of m
words takes about m ln m comparisons, not m^2, whatever its length.

Texts are worked on whole, each by itself, without a shuffle. Words are runs of anything but ASCII white space and are compared byte
by byte.

Defined results: null, empty and blank texts have no words and no runs; their collapsed text is empty. Texts of one word
repeated are one run of period 1. Repeated rows give repeated results. A very long text is one row's work, with memory in
proportion to its words. A null doc_id is kept. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from locusloom.llm.common import small_batches

#: Words in the shortest run.
LEAST = 12
#: Splitting ends when it has looked at each word this often. Scanning finds the same runs in whatever segments are left.
LOOKS = 64

Run = tuple[int, int, int]  # start, length, period


def _neighbours(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distance of every word to the one before and after it of its kind; beyond any text where there is none."""
    n = len(ids)
    before, after = np.full(n, 2 * n + 1), np.full(n, 2 * n + 1)
    order = np.argsort(ids, kind="stable")
    same = ids[order[1:]] == ids[order[:-1]]
    left, right = order[:-1][same], order[1:][same]
    before[right] = after[left] = right - left
    return before, after


def segments(ids: np.ndarray) -> list[tuple[int, int]]:
    """The stretches that no rare word splits any more."""
    before, after = _neighbours(ids)
    work, out, looked = [(0, len(ids))], [], 0
    while work:
        low, high = work.pop()
        size = high - low
        if size < LEAST:
            continue
        if looked > LOOKS * len(ids):
            out.append((low, high))
            continue
        looked += size
        place = np.arange(size)
        near = (before[low:high] <= np.minimum(place, size // 2)) | (after[low:high] <= np.minimum(size - 1 - place, size // 2))
        rare = np.flatnonzero(~near)
        if len(rare) == 0:
            out.append((low, high))
            continue
        edges = np.concatenate([[-1], rare, [size]]) + low
        long = np.flatnonzero(np.diff(edges) > LEAST)
        work += [(int(edges[i]) + 1, int(edges[i + 1])) for i in long]
    return sorted(out)


def _reach(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading entries of two arrays agree, looking no further than twice as far."""
    n, done, step = min(len(a), len(b)), 0, 16
    while done < n:
        same = a[done:done + step] == b[done:done + step]
        first = int(same.argmin())
        if not same[first]:
            return done + first
        done, step = done + len(same), step * 2
    return n


def _outside(hits: np.ndarray, known: list[tuple[int, int]]) -> np.ndarray:
    """The hits in none of the known stretches."""
    known.sort()
    ends = np.maximum.accumulate([b for _, b in known])
    at = np.searchsorted([a for a, _ in known], hits, side="right") - 1
    return hits[(at < 0) | (hits >= ends[at])]


def _stretches(ids: np.ndarray, lag: int, known: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Every longest stretch [a, b) of places that agree with the place ``lag`` words on, of at least max(lag, LEAST - lag),
    but for the known ones."""
    m, least = len(ids), max(lag, LEAST - lag)
    here, there = ids[:m - lag], ids[lag:]
    hits = np.flatnonzero(here[::least] == there[::least]) * least
    if known and len(hits):
        hits = _outside(hits, known)
    if len(hits) > 1 and least > 6:  # half of the stretch lies to one side of its first hit
        half = (least - 1) // 2
        right = left = np.ones(len(hits), dtype=bool)
        for k in range(1, min(half, 3) + 1):
            on, back = hits + k, hits - k
            right = right & (on < m - lag) & (here[np.minimum(on, m - lag - 1)] == there[np.minimum(on, m - lag - 1)])
            left = left & (back >= 0) & (here[np.maximum(back, 0)] == there[np.maximum(back, 0)])
        hits = hits[right | left]
    end = 0
    for hit in hits.tolist():
        if hit < end:
            continue
        b = hit + _reach(here[hit:], there[hit:])
        a = hit - _reach(here[end:hit][::-1], there[end:hit][::-1])
        end = b
        if b - a >= least:
            yield a, b


def runs(ids: np.ndarray) -> list[Run]:
    """All runs of a text whose words are given as numbers, by start, then period."""
    found: dict[tuple[int, int], int] = {}
    for low, high in segments(ids):
        part, known = ids[low:high], defaultdict(list)
        for lag in range(1, len(part) // 2 + 1):
            for a, b in _stretches(part, lag, known.pop(lag, [])):
                found[low + a, b - a + lag] = lag
                for other in range(2 * lag, b - a + lag, lag):  # at multiples of its period, a run is no new one
                    known[other].append((a, b + lag - other))
    return sorted((start, length, lag) for (start, length), lag in found.items())


def numbered(words: list[bytes]) -> np.ndarray:
    ids: dict[bytes, int] = {}
    return np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int32, count=len(words))


def kept_places(n: int, found: list[Run]) -> np.ndarray:
    """True for words that no run repeats: those in no run, or only in first periods."""
    edges = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in found:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:n]) == 0


def looped(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """A text made to repeat itself from some word on, for one doc_id in ten: the digest query's own edit."""
    n = len(words)
    if doc_id is None or n == 0:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    turns = -(-(n - a) // p)
    return words[:a] + (words[a:a + p] * turns)[:n - a]


def _found(texts: list[bytes | None], doc_ids: list, edit: Callable | None) -> Iterator[tuple[list[bytes], list[Run], list[bytes]]]:
    for doc_id, text in zip(doc_ids, texts):
        words = (text or b"").split()
        if edit:
            words = edit(doc_id, words)
        own = runs(numbered(words)) if len(words) >= LEAST else []
        yield words, own, [w for w, keep in zip(words, kept_places(len(words), own)) if keep] if own else words


def _whole_texts(batch: pa.RecordBatch) -> tuple[pa.Array, list[bytes | None]]:
    column = lambda name: batch.column(batch.schema.get_field_index(name))
    return column("doc_id"), column("text").cast(pa.binary()).to_pylist()


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, runs (start, length, period of each, in words) and the text without what its runs repeat."""
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]
        for batch in batches:
            ids, texts = _whole_texts(batch)
            made = [(own, b" ".join(kept).decode("utf-8", "replace")) for _, own, kept in _found(texts, ids.to_pylist(), None)]
            found = pa.array([[dict(zip(("start", "length", "period"), r)) for r in own] for own, _ in made], type=pa.list_(pa.struct(fields)))
            yield pa.RecordBatch.from_arrays([ids, found, pa.array([t for _, t in made], type=pa.string())], names=["doc_id", "runs", "collapsed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.selectExpr("doc_id", "CAST(text AS string) AS text")
    return rows.mapInArrow(work, f"doc_id {kind}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def run_digests(docs: DataFrame, edit: Callable[[int | None, list[bytes]], list[bytes]] | None = looped) -> DataFrame:
    """Number of runs, the longest one, and digests of all runs and of the collapsed text, after ``edit``."""
    small_batches(docs.sparkSession)
    numbers = ["n_runs", "start", "length", "period", "exponent_milli"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = _whole_texts(batch)
            rows, digests, collapsed = [], [], []
            for _, own, kept in _found(texts, ids.to_pylist(), edit):
                best = min(own, key=lambda r: (-r[1], r[0], r[2]), default=None)
                rows.append((len(own), *(best or (None,) * 3), best and 1000 * best[1] // best[2]))
                digests.append(hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in own).encode()).hexdigest())
                collapsed.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            columns = [pa.array([r[k] for r in rows], type=pa.int64()) for k in range(5)]
            yield pa.RecordBatch.from_arrays(
                [ids, *columns, pa.array(digests, type=pa.string()), pa.array(collapsed, type=pa.string())],
                names=["doc_id", *numbers, "runs_sha256", "collapsed_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.selectExpr("doc_id", "CAST(text AS string) AS text")
    schema = f"doc_id {kind}, " + ", ".join(f"{c} bigint" for c in numbers) + ", runs_sha256 string, collapsed_sha256 string"
    return rows.mapInArrow(work, schema)
