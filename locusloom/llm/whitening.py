"""Embedding whitening by Chebyshev-filtered subspace iteration.

The covariance V of all vectors is never formed. A block of ``components + GUARD`` directions Q is filtered instead: each
degree of a Chebyshev polynomial is one distributed pass for V Q = Xc'(Xc Q) / n over the centred rows (partial matrices per
partition, summed row by row by an aggregate; d rows of the block's width reach the driver). The polynomial stays within
1 on the unwanted part of the spectrum and grows beyond it; then QR, Rayleigh-Ritz, and again, until the residuals
|V q - e q| certify every pair. The unwanted part lies between a Lanczos bound (one more column in every pass) and the
block's least Ritz value. A block that is not certified after ``ROUNDS`` rounds is doubled; one as wide as the space is exact
after one pass, so the iteration ends for every input.

Entries become whole numbers x = floor(1024 c) + 100000, so counts, sums and deviations are exact: a row is centred by the whole
part of its mean first and by the rest (below 1) then, which loses no digits.

Defined results: vectors that are null, empty or hold null or non-finite entries take no part, nor do vectors of another
length than the most frequent one (of those, the least). Entries with |floor(1024 c)| above 2^61 count as 2^61. Repeated rows
and ids count as often as they stand; a null vec_id is kept. Directions without variance (below 1e-12 of the trace) are no
components, so there may be fewer than asked for, and none for a single vector or a constant table. Components of equal
eigenvalues are any basis of their space. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusloom.llm.common import stage

COMPONENTS = 8
#: Directions in the block besides the wanted ones.
GUARD = 24
#: Residuals, as a share of the greatest eigenvalue: certified below SURE; below ENOUGH if rounding lets them fall no more.
SURE, ENOUGH = 2e-14, 1e-10
#: Rounds until the block is doubled, highest degree of a filter, and how much more it may raise the first pair than the last.
ROUNDS, DEGREE, LIFT = 16, 12, 1e8
SCALE, SHIFT, MOST = 1024.0, 100_000, float(2**61)


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id and embedding of the vectors that take part."""
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = embeddings.select("vec_id", "embedding").filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite)
    lengths = rows.groupBy(F.size("embedding").alias("d")).count()
    common = lengths.orderBy(F.desc("count"), "d").limit(1).select("d").collect()  # one number
    return rows.filter(F.size("embedding") == (common[0]["d"] if common else 0))


def _entries(batch: pa.RecordBatch, d: int) -> np.ndarray:
    """x - SHIFT of a batch, rows by dimensions."""
    flat = batch.column(batch.schema.get_field_index("embedding")).flatten().to_numpy(zero_copy_only=False)
    whole = np.floor(flat.astype(np.float64) * SCALE)
    return np.clip(whole, -MOST, MOST).astype(np.int64).reshape(-1, d)


@dataclass(frozen=True)
class Means:
    """Exact means of x - SHIFT: the whole part and what is left of each sum, below n."""

    n: int
    whole: np.ndarray
    left: np.ndarray

    def centred(self, entries: np.ndarray) -> np.ndarray:
        return (entries - self.whole).astype(np.float64) - self.left / self.n

    def deviations(self, entries: np.ndarray) -> list[int]:
        """Sum over dimensions of (n x - S)^2, exactly."""
        apart = entries - self.whole
        most = (float(np.abs(apart).max(initial=0)) + 1) * self.n
        kind = object if most * most * apart.shape[1] >= 2**62 else np.int64
        scaled = apart.astype(kind) * self.n - np.array([int(v) for v in self.left], dtype=kind)
        return [int(v) for v in (scaled * scaled).sum(axis=1)]


def means(rows: DataFrame, d: int) -> Means:
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for batch in batches:
            entries = _entries(batch, d)
            n += len(entries)
            high, low = (entries >> 32).sum(axis=0), (entries & 0xFFFFFFFF).sum(axis=0)
            total = [t + (int(h) << 32) + int(x) for t, h, x in zip(total, high, low)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(d + 1), type=pa.int32()), pa.array([*total, n], type=pa.decimal128(38, 0))], names=["i", "total"])

    parts = rows.select("embedding").mapInArrow(sums, "i int, total decimal(38,0)")
    by_place = {r["i"]: int(r["total"]) for r in parts.groupBy("i").agg(F.sum("total").alias("total")).collect()}  # d + 1 rows
    n = by_place.get(d, 0)
    split = [divmod(by_place[i], n) for i in range(d)] if n else []
    whole, left = ([s[k] for s in split] for k in (0, 1))
    return Means(n, np.array(whole, dtype=np.int64), np.array(left, dtype=object).astype(np.float64) if n < 2**53 else np.array(left, dtype=object))


def summed(rows: DataFrame, d: int, height: int, width: int, work: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all batches of a matrix of fixed shape: one matrix per partition, then one aggregate by matrix row."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((height, width))
        for batch in batches:
            total += work(_entries(batch, d))
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(height), type=pa.int32()), *(pa.array(total[:, j]) for j in range(width))],
            names=["i", *(f"v{j}" for j in range(width))])

    columns = [f"v{j}" for j in range(width)]
    parts = rows.select("embedding").mapInArrow(partial, "i int, " + ", ".join(f"{c} double" for c in columns))
    out = np.zeros((height, width))
    for r in parts.groupBy("i").agg(*[F.sum(c).alias(c) for c in columns]).collect():  # height rows
        out[r["i"]] = r[1:]
    return out


class _Lowest:
    """A lower bound of the spectrum from Lanczos steps, one in every pass."""

    def __init__(self, d: int, rng: np.random.Generator):
        start = rng.normal(size=d)
        self.basis, self.alpha, self.beta, self.bound = [start / np.linalg.norm(start)], [], [], 0.0

    def vector(self) -> np.ndarray:
        return self.basis[-1]

    def step(self, image: np.ndarray) -> None:
        if len(self.alpha) == len(self.basis):
            return  # the space is used up
        self.alpha.append(float(self.basis[-1] @ image))
        known = np.array(self.basis)
        for _ in range(2):
            image = image - known.T @ (known @ image)
        rest = float(np.linalg.norm(image))
        values = np.linalg.eigvalsh(np.diag(self.alpha) + np.diag(self.beta, 1) + np.diag(self.beta, -1))
        self.bound = max(0.0, float(values[0]) - rest)
        if rest > 1e-10 * max(abs(values[-1]), 1e-300) and len(self.basis) < len(image):
            self.beta.append(rest)
            self.basis.append(image / rest)


@dataclass(frozen=True)
class Spectrum:
    """Leading eigenvalues (falling), their unit vectors as columns, the trace, and how it went."""

    values: np.ndarray
    vectors: np.ndarray
    trace: float
    passes: int
    residual: float


def leading(apply: Callable[[np.ndarray], tuple[np.ndarray, float]], d: int, components: int, guard: int = GUARD, seed: int = 11) -> Spectrum:
    """Leading pairs of a covariance that is known by what it makes of a block (and its trace) alone."""
    rng = np.random.default_rng(seed)
    wanted, lowest, passes, trace = min(components, d), _Lowest(d, rng), 0, 0.0

    def passed(block: np.ndarray) -> np.ndarray:
        nonlocal passes, trace
        image, trace = apply(np.column_stack([block, lowest.vector()]))
        lowest.step(image[:, -1])
        passes += 1
        return image[:, :-1]

    width, q = min(d, wanted + guard), np.empty((d, 0))
    while True:
        q = np.linalg.qr(np.column_stack([q, rng.normal(size=(d, width - q.shape[1]))]))[0]
        before = np.inf
        for _ in range(ROUNDS):
            image = passed(q)
            inner = q.T @ image
            values, turn = np.linalg.eigh((inner + inner.T) / 2)
            values, turn = values[::-1], turn[:, ::-1]
            q, image = q @ turn, image @ turn
            residual = float(np.linalg.norm(image[:, :wanted] - q[:, :wanted] * values[:wanted], axis=0).max())
            top = max(values[0], 1e-300)
            settled = residual <= SURE * top or (residual <= ENOUGH * top and residual > before / 2)
            if settled or width == d or trace <= 0:
                return Spectrum(values[:wanted], q[:, :wanted], trace, passes, residual)
            before = residual
            q = np.linalg.qr(_filtered(passed, q, image, values, lowest.bound, wanted))[0]
        width = min(d, 2 * width)


def _filtered(passed: Callable[[np.ndarray], np.ndarray], q: np.ndarray, image: np.ndarray, values: np.ndarray, low: float, wanted: int) -> np.ndarray:
    """T_m of V, moved so that [low, least Ritz value] is [-1, 1], times q; ``image`` is V q, the first degree."""
    cut = values[-1]
    low = min(low, cut * (1 - 1e-6))
    centre, half = (cut + low) / 2, max((cut - low) / 2, 1e-12 * values[0])
    first, last = (np.arccosh(max((values[i] - centre) / half, 1.0)) for i in (0, wanted - 1))
    degree = int(np.clip(np.log(LIFT) / max(first - last, 1e-9), 2, DEGREE))
    sigma = scale = half / (values[0] - centre)
    previous, block = q, (image - centre * q) * (sigma / half)
    for _ in range(degree - 1):
        following = 1.0 / (2.0 / scale - sigma)
        previous, block = block, (passed(block) - centre * block) * (2 * following / half) - (sigma * following) * previous
        sigma = following
    return block / np.linalg.norm(block, axis=0)


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: means, components and shares of variance, the fit's own error, and the vectors it was fitted on."""

    means: Means
    spectrum: Spectrum
    explained: np.ndarray
    identity_error: float
    rows: DataFrame

    def _project(self) -> Callable[[np.ndarray], np.ndarray]:
        centre, turn = self.means, self.spectrum.vectors / np.sqrt(self.spectrum.values)
        return lambda entries: centre.centred(entries) @ turn

    def transformed(self) -> DataFrame:
        """vec_id, deviation (exact, decimal) and whitened (an array, one entry per component) of every vector."""
        centre, d, project = self.means, len(self.means.whole), self._project()

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                entries = _entries(batch, d)
                out = project(entries)
                ends = np.arange(len(out) + 1, dtype=np.int32) * out.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(batch.schema.get_field_index("vec_id")), pa.array(centre.deviations(entries), type=pa.decimal128(38, 0)),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()))], names=["vec_id", "deviation", "whitened"])

        kind = self.rows.schema["vec_id"].dataType.simpleString()
        return self.rows.mapInArrow(work, f"vec_id {kind}, deviation decimal(38,0), whitened array<double>")


def fitted(embeddings: DataFrame, components: int = COMPONENTS, guard: int = GUARD) -> Whitening:
    """Fit on all usable vectors: two passes for counts and sums, one per degree of each filter, one for the error."""
    rows = stage(usable(embeddings), "vectors")
    size = rows.select(F.size("embedding").alias("d")).limit(1).collect()
    d = size[0]["d"] if size else 0
    centre = means(rows, d) if d else Means(0, np.empty(0, dtype=np.int64), np.empty(0))

    def apply(block: np.ndarray) -> tuple[np.ndarray, float]:
        def work(entries: np.ndarray) -> np.ndarray:
            own = centre.centred(entries)
            return np.column_stack([own.T @ (own @ block), (own * own).sum(axis=0)])

        out = summed(rows, d, d, block.shape[1] + 1, work) / centre.n
        return out[:, :-1], float(out[:, -1].sum())

    if centre.n == 0:
        return Whitening(centre, Spectrum(np.empty(0), np.empty((0, 0)), 0.0, 0, 0.0), np.empty(0), 0.0, rows)
    found = leading(apply, d, components, guard)
    kept = int((found.values > 1e-12 * found.trace).sum()) if found.trace > 0 else 0
    signs = np.sign(found.vectors[np.abs(found.vectors).argmax(axis=0), np.arange(found.vectors.shape[1])])
    found = Spectrum(found.values[:kept], (found.vectors * signs)[:, :kept], found.trace, found.passes, found.residual)
    bare = Whitening(centre, found, found.values / found.trace if kept else found.values, 0.0, rows)
    if not kept:
        return bare
    project = bare._project()

    def moments(entries: np.ndarray) -> np.ndarray:
        out = project(entries)
        return np.column_stack([out.T @ out, out.sum(axis=0)])

    sums = summed(rows, d, kept, kept + 1, moments) / centre.n
    covariance = sums[:, :-1] - np.outer(sums[:, -1], sums[:, -1])
    return Whitening(centre, found, bare.explained, float(np.abs(covariance - np.eye(kept)).max()), rows)


def whitened(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component (numbered from 1): the whitened value beside what the fit says of it."""
    fit = fitted(embeddings, components)
    shares = F.array(*[F.lit(float(e)) for e in fit.explained]).cast("array<double>")
    rows = fit.transformed().select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(fit.means.n).cast("bigint").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(fit.identity_error).alias("identity_error"))
