"""Whitening of vectors on their leading principal components, by Chebyshev-filtered subspace iteration.

Entries become integers x = floor(64 * c) + 1000000; the fit list is each distinct x vector once (n vectors, sums S). No
task sees a covariance matrix of the rows: what is distributed is a pass that gives V Q for a thin Q, as the sum over
blocks of C' (C Q) / n with the centred C = (n * x - S) / n, whose numerator is an exact integer. A pass reads the blocks
once; a task sends one row a dimension, and these are added up by dimension.

The subspace has COMPONENTS + EXTRA columns. A cycle runs the three-term recurrence of a Chebyshev polynomial that is small
on [low, high] and grows fast above it, one pass a degree; then QR, a pass for V Q, and Rayleigh-Ritz. high is the least
Ritz value of the subspace. low comes from a Lanczos column that rides along in the first RIDES passes (its least Ritz
value less its last residual), 0 before that. Components that are certified are held out of all later steps. The degree is bounded by MOST_DEGREE, and so that the largest eigenvalue isn't
raised more than 10**8 times above the last component's, among those not held. V Q of the Rayleigh-Ritz pass is the first step of the next cycle.

Certificate: every component has |V q - e q| <= TOLERANCE * e_1, so e is within that of an eigenvalue, and q within that
over the gap of its eigenvector. A subspace that stops improving before is accepted below ROUNDING * e_1 (sums of very many
rows), else it is an error after CYCLES cycles. The identity error is measured by one more pass over the fit list.

Cases: null vectors, those with null or non-finite entries (or beyond 2**50) and those of another length than the table's
most common one are dropped; repeated rows are rows of the result each, and one vector of the fit list; a null vec_id stays
null; components with no variance (e <= 1e-12 * e_1: equal vectors, fewer vectors than dimensions) are left out, so a table
of one distinct vector, or an empty one, gives no rows; a deviation beyond 64 bits is null; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written
from .vectors import MOST_BYTES, blobs, dimension, joined, scaled
from .words import trimmed

SCALE, SHIFT = 64, 1_000_000
COMPONENTS, EXTRA = 16, 16
TOLERANCE, ROUNDING, CYCLES, MOST_DEGREE, RIDES = 1e-13, 1e-10, 60, 10, 12
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _packed(d: int) -> Callable:
    """x of each row that counts, as bytes: 16 bits an entry about SHIFT where that fits the row, else 64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in scaled(batch, d, SCALE):
                small = (np.abs(x) < 1 << 15).all(axis=1)
                for rows in (x[small].astype("<i2"), x[~small].astype("<i8")):
                    if len(rows):
                        yield pa.RecordBatch.from_arrays([blobs(rows)], ["x"])

    return run


def _vectors(column: pa.Array, d: int) -> Iterator[np.ndarray]:
    """x of a binary column of `_packed`."""
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False)
    for kind in ("<i2", "<i8"):
        own = np.flatnonzero(sizes == d * np.dtype(kind).itemsize)
        if len(own):
            yield joined(column.take(pa.array(own))).view(kind).reshape(-1, d).astype(np.int64) + SHIFT


def _blocks(d: int) -> Callable:
    """Distinct vectors as blocks of some MB: x as bytes of 64-bit integers, which the file's compression makes small."""
    most = max(1, MOST_BYTES // (8 * d))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                for x in _vectors(batch.column("x").slice(at, most), d):
                    held.append(x)
                    size += len(x)
                if size >= most:
                    yield pa.RecordBatch.from_pydict({"x": [np.concatenate(held).astype("<i8").tobytes()]})
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pydict({"x": [np.concatenate(held).astype("<i8").tobytes()]})

    return run


def _each(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield np.frombuffer(batch.column("x")[k].as_buffer(), "<i8").reshape(-1, d)


class Fit:
    """n, S of the fit list, and what a task needs to centre vectors."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums, self.d = n, sums, len(sums)
        self.exact = n * (SHIFT + 2 * SCALE) < 1 << 62 and max(map(abs, sums), default=0) < 1 << 62

    def spread(self, x: np.ndarray) -> np.ndarray:
        """n * x - S: 64-bit integers, or Python's where these may not do."""
        if self.exact and np.abs(x).max(initial=0) < (1 << 62) // max(self.n, 1):
            return x * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.spread(x) / self.n).astype(np.float64)

    def deviation(self, spread: np.ndarray) -> np.ndarray | list:
        about = (spread.astype(np.float64) ** 2).sum(axis=1)
        if spread.dtype == np.int64 and about.max(initial=0) < 2.0**62:
            return (spread * spread).sum(axis=1)
        exact = (spread.astype(object) ** 2).sum(axis=1)
        return [int(v) if v < 1 << 63 else None for v in exact]


def _totals(blocks: DataFrame, d: int) -> Fit:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(d, object)
        for x in _each(batches, d):
            n += len(x)
            sums = sums + (x.sum(axis=0) if np.abs(x).max() < 1 << 40 else x.astype(object).sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(list(map(int, sums)), pa.decimal128(38, 0))], ["i", "n", "s"])

    found = blocks.mapInArrow(run, "i int, n long, s decimal(38,0)").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("i").collect()
    return Fit(found[0]["n"] if found else 0, [int(r["s"]) for r in found])


def _summed(blocks: DataFrame, d: int, of: Callable[[np.ndarray], np.ndarray], rows: int, columns: int) -> np.ndarray:
    """The sum over all blocks of of(x), a matrix of `rows` and `columns`, both bounded by the dimension."""
    names = [f"v{j}" for j in range(columns)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((rows, columns))
        for x in _each(batches, d):
            total += of(x)
        yield pa.RecordBatch.from_arrays([pa.array(range(rows), pa.int32()), *[pa.array(total[:, j]) for j in range(columns)]], ["i", *names])

    parts = blocks.mapInArrow(trimmed(run), ", ".join(["i int", *[f"{c} double" for c in names]]))
    out = np.zeros((rows, columns))
    for r in parts.groupBy("i").agg(*[F.sum(c).alias(c) for c in names]).collect():
        out[r[0]] = r[1:]
    return out


class _Passes:
    """V Q by a pass over the blocks; the first also gives the trace."""

    def __init__(self, blocks: DataFrame, fit: Fit):
        self.blocks, self.fit, self.trace, self.count = blocks, fit, 0.0, 0

    def __call__(self, q: np.ndarray) -> np.ndarray:
        fit = self.fit

        def of(x: np.ndarray) -> np.ndarray:
            c = fit.centred(x)
            return np.hstack([c.T @ (c @ q), (c * c).sum(axis=0)[:, None]])

        self.count += 1
        found = _summed(self.blocks, fit.d, of, fit.d, q.shape[1] + 1) / fit.n
        self.trace = float(found[:, -1].sum())
        return found[:, :-1]


class _Lanczos:
    """A column that rides along: bounds the spectrum from below."""

    def __init__(self, start: np.ndarray):
        self.basis, self.alpha, self.beta = [start / np.linalg.norm(start)], [], []

    def take(self, image: np.ndarray) -> None:
        self.alpha.append(float(self.basis[-1] @ image))
        known = np.array(self.basis).T
        rest = image - known @ (known.T @ image)
        rest -= known @ (known.T @ rest)
        self.beta.append(float(np.linalg.norm(rest)))
        self.basis.append(rest / self.beta[-1] if self.beta[-1] else rest)

    def least(self) -> float:
        if not self.alpha:
            return 0.0
        t = np.diag(self.alpha) + np.diag(self.beta[:-1], 1) + np.diag(self.beta[:-1], -1)
        values, vectors = np.linalg.eigh(t)
        return max(0.0, float(values[0] - abs(self.beta[-1] * vectors[-1, 0]) - 1e-3 * abs(values[0])))


def _degree(top: float, last: float, low: float, high: float) -> int:
    """The largest degree that raises the first component at most 10**8 times above the last."""
    place = lambda e: np.arccosh(max(1.0, (2 * e - low - high) / max(high - low, 1e-300)))
    spread = place(top) - place(last)
    return int(min(MOST_DEGREE, max(2, np.log(1e8) / spread if spread > 0 else MOST_DEGREE)))


def components(times: Callable[[np.ndarray], np.ndarray], d: int, count: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors (columns) of the matrix behind times(Q)."""
    width, wanted = min(d, count + EXTRA), min(d, count)
    rng = np.random.Generator(np.random.Philox(key=11))
    q = np.eye(d) if width == d else np.linalg.qr(times(np.linalg.qr(rng.standard_normal((d, width)))[0]))[0]
    image, low, best, top = times(q), 0.0, np.inf, 0.0
    lanczos = _Lanczos(rng.standard_normal(d))
    held, known = np.zeros((d, 0)), np.zeros(0)  # certified components, kept out of all that follows
    for _ in range(CYCLES):
        inner = q.T @ image
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, image = q @ turn, image @ turn
        top = max(top, float(values[0]))
        errors = np.linalg.norm(image - q * values, axis=0)
        error = float(errors[: wanted - len(known)].max(initial=0.0))
        if error <= TOLERANCE * top or width == d or (error <= ROUNDING * top and error > best / 2):
            order = np.argsort(-np.concatenate([known, values]), kind="stable")[:wanted]
            return np.concatenate([known, values])[order], np.hstack([held, q])[:, order]
        sure = int(np.argmax(errors > TOLERANCE * top))
        best = min(best, error) if not sure else error
        held, known = np.hstack([held, q[:, :sure]]), np.concatenate([known, values[:sure]])
        q, image, values = q[:, sure:], image[:, sure:], values[sure:]
        away = lambda y, held=held: y - held @ (held.T @ y)
        high = max(float(values[-1]), 1e-10 * float(values[0]))
        low = min(low, high / 2) if low >= high else low
        centre, half = (high + low) / 2, (high - low) / 2
        # T_k((V - centre) / half) Q, scaled by its own growth at the largest eigenvalue so that nothing overflows
        sigma = rate = half / (float(values[0]) - centre)
        older, y = q, away((image - centre * q) * (sigma / half))
        for _ in range(_degree(values[0], values[wanted - len(known) - 1], low, high) - 1):
            rides = len(lanczos.alpha) < min(RIDES, d) and 0.0 not in lanczos.beta
            found = times(np.column_stack([y, lanczos.basis[-1]]) if rides else y)
            if rides:
                lanczos.take(found[:, -1])
                found = found[:, :-1]
            fresh = 1 / (2 / rate - sigma)
            older, y = y, away((found - centre * y) * (2 * fresh / half) - (sigma * fresh) * older)
            sigma = fresh
        low = max(low, lanczos.least())
        q = away(np.linalg.qr(y / np.maximum(np.linalg.norm(y, axis=0), 1e-300))[0])
        q = np.linalg.qr(q)[0]
        image = away(times(q))
    raise RuntimeError(f"the components are not certified after {CYCLES} cycles: residual {error:.3g}, largest eigenvalue {top:.3g}")


def whiten(rows: DataFrame, count: int = COMPONENTS) -> DataFrame:
    """SCHEMA for each row that counts and each component. rows: vec_id, embedding."""
    spark = rows.sparkSession
    slim = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    d = dimension(slim)
    if not d:
        return spark.createDataFrame([], SCHEMA)
    distinct = slim.select("embedding").mapInArrow(trimmed(_packed(d)), "x binary").distinct()
    blocks = written(distinct.mapInArrow(trimmed(_blocks(d)), "x binary"), "zstd")
    fit = _totals(blocks, d)
    if not fit.n:
        return spark.createDataFrame([], SCHEMA)
    times = _Passes(blocks, fit)
    values, q = components(times, d, count)
    own = values > max(1e-12 * float(values[0]), 0.0)
    values, q = values[own], q[:, own]
    p = len(values)
    if not p:
        return spark.createDataFrame([], SCHEMA)
    onto = q / np.sqrt(values)

    def second(x: np.ndarray) -> np.ndarray:
        w = fit.centred(x) @ onto
        return np.vstack([w.T @ w, w.sum(axis=0)])

    moments = _summed(blocks, d, second, p + 1, p) / fit.n
    identity = float(np.abs(moments[:-1] - np.outer(moments[-1], moments[-1]) - np.eye(p)).max())
    explained = values / times.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x in scaled(batch, d, SCALE, SHIFT):
                spread = fit.spread(x)
                deviation = pa.array(fit.deviation(spread), pa.int64())
                w = (spread / fit.n).astype(np.float64) @ onto
                again = pa.array(np.repeat(np.arange(len(x)), p))
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id").take(again), pa.array(np.tile(np.arange(1, p + 1, dtype=np.int32), len(x))), pa.array(np.full(len(again), fit.n)), deviation.take(again), pa.array(w.ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(again), identity))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return slim.mapInArrow(trimmed(run), SCHEMA)


def op11(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
