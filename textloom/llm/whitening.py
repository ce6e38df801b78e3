"""Whitening of vectors by the leading eigenvectors of their covariance, found by block Lanczos.

The covariance is never formed. A pass over the rows sends a block of vectors ``Q`` of some
columns out and brings ``sum of c (c' Q)`` back, where ``c`` is a centred row: each task adds
up its own part, Spark adds the parts up by dimension, and the driver sees dimensions times
columns. The new block is orthogonalised twice against all before it; a column that vanishes
there (breakdown: an invariant subspace is found) starts again from a fresh direction, until
the directions are used up. The leading Ritz pairs have converged once their residuals are
``tolerance`` times the largest eigenvalue. Where the basis would pass ``most_basis``
columns, its leading Ritz vectors take its place (thick restart).

Components are components x's: entries are made whole numbers by ``floor(scale * entry)``, so
counts, sums and deviations are exact whatever the order of the rows. Every different vector
counts once (``fit`` rows); the covariance is centred before multiplying, with divisor n, and
its trace is the sum of the rows' deviations.

Defined results. Vectors that are null, hold null or non-finite entries, or have not the
length that most vectors have (of equally frequent lengths the least) give no rows; nor do
empty ones. Repeated rows and equal vectors each give rows, a null id stays null. Components
that carry no variance (an eigenvalue under 1e-12 of the trace) can't be scaled to one and
are left out: a single vector, or one repeated, gives no rows, and neither does an empty
table. A deviation beyond 64 bits is null. Whole numbers beyond 2^60 count as 2^60.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored, table

#: Widths in bytes that a fit vector may have per entry: the least that holds all of it.
WIDTHS = (1, 2, 4, 8)
#: Bound of ``n * x - S`` per entry under which deviations are added up in 64 bits.
SAFE = 1 << 62
#: Entries beyond are cut to it.
FAR = 2.0**60


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v array<double>) of the vectors without null or non-finite entries."""
    v = F.col(vec_col).cast("array<double>")
    whole = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return rows.select(F.col(id_col).alias("id"), v.alias("v")).where(F.col("v").isNotNull() & whole)


def entries(v: pa.Array, scale: float) -> np.ndarray:
    """The rows of a list column of one length as whole numbers."""
    flat = v.flatten().to_numpy(zero_copy_only=False)
    return np.clip(np.floor(flat * scale), -FAR, FAR).astype(np.int64).reshape(len(v), -1)


def narrow(x: np.ndarray) -> bytes:
    """A vector in the least width that holds it; equal vectors give equal bytes."""
    low, high = int(x.min()), int(x.max())
    width = next(w for w in WIDTHS if -(1 << 8 * w - 1) <= low and high < 1 << 8 * w - 1)
    return x.astype(f"<i{width}").tobytes()


def widened(cells: list[bytes], dims: int) -> np.ndarray:
    out = np.empty((len(cells), dims), dtype=np.int64)
    for i, cell in enumerate(cells):
        out[i] = np.frombuffer(cell, f"<i{len(cell) // dims}")
    return out


def fit_rows(vectors: DataFrame, scale: float) -> DataFrame:
    """(x binary): each different vector once. Repeats go before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = list(dict.fromkeys(narrow(x) for x in entries(b.column("v"), scale))) if b.num_rows else []
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.binary())], names=["x"])

    return vectors.select("v").mapInArrow(run, "x binary").distinct()


@dataclass(frozen=True)
class Moments:
    """Count and exact sums by dimension of the fit rows, and their deviations' sum over ``n * n``."""

    n: int
    sums: list[int]
    deviation: float

    @property
    def dims(self) -> int:
        return len(self.sums)

    @property
    def trace(self) -> float:
        return self.deviation / self.n

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x - S / n``, rounded once where ``n * x`` fits 64 bits."""
        sums, low, high = self.sums, int(x.min(initial=0)), int(x.max(initial=0))
        if self.n * max(-low, high) + max(map(abs, sums)) < SAFE:
            return (x * self.n - np.array(sums, dtype=np.int64)) / self.n
        whole = np.array([s // self.n for s in sums], dtype=np.int64)
        return (x - whole) - np.array([s % self.n / self.n for s in sums])

    def deviations(self, x: np.ndarray) -> list[int]:
        """The exact sum over dimensions of ``(n * x - S) ** 2`` of each row."""
        sums, low, high = self.sums, int(x.min(initial=0)), int(x.max(initial=0))
        most = self.n * max(-low, high) + max(map(abs, sums))
        if most * most * len(sums) < SAFE * 2:
            return ((x * self.n - np.array(sums, dtype=np.int64)) ** 2).sum(axis=1).tolist()
        if most < SAFE:
            # Split into high and low halves, so that squares stay within 64 bits.
            d = abs(x * self.n - np.array(sums, dtype=np.int64))
            if int(d.max(initial=0)) < 1 << 52 and len(sums) <= 1024:
                hi, lo = d >> 26, d & (1 << 26) - 1
                parts = ((hi * hi).sum(axis=1), (hi * lo).sum(axis=1), (lo * lo).sum(axis=1))
                return [(a << 52) + (b << 27) + c for a, b, c in zip(*(p.tolist() for p in parts), strict=True)]
        return [sum((self.n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]


def moments(fit: DataFrame, dims: int) -> Moments | None:
    """In two passes; each task brings one row for a dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * dims
        for b in batches:
            x = widened(b.column("x").to_pylist(), dims)
            n += len(x)
            hi, lo = x >> 32, x & 0xFFFFFFFF
            sums = [s + (int(h) << 32) + int(w) for s, h, w in zip(sums, hi.sum(axis=0), lo.sum(axis=0), strict=True)]
        yield whole_numbers([n, *sums])

    found = summed(fit.mapInArrow(add, "k int, v decimal(38,0)"))
    if not found or not found[0]:
        return None
    first = Moments(found[0], found[1:], 0.0)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = sum(sum(first.deviations(widened(b.column("x").to_pylist(), dims))) for b in batches)
        yield pa.RecordBatch.from_arrays([pa.array([whole / first.n / first.n], pa.float64())], names=["v"])

    return Moments(first.n, first.sums, fit.mapInArrow(spread, "v double").agg(F.sum("v").alias("v")).first().v)


def whole_numbers(values: list[int]) -> pa.RecordBatch:
    cells = pa.array([decimal.Decimal(v) for v in values], pa.decimal128(38, 0))
    return pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), cells], names=["k", "v"])


def summed(parts: DataFrame) -> list[int]:
    return [int(r.v) for r in parts.groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").collect()]


def products(fit: DataFrame, m: Moments, block: np.ndarray, square: bool = False) -> np.ndarray:
    """``V block`` over the fit rows; with ``square``, the covariance of their projections ``c' block``."""
    out_rows = block.shape[1] if square else m.dims

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((out_rows, block.shape[1]))
        for b in batches:
            if b.num_rows:
                c = m.centred(widened(b.column("x").to_pylist(), m.dims))
                p = c @ block
                total += (p if square else c).T @ p
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(out_rows), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["k", "v"]
        )

    parts = fit.mapInArrow(run, "k int, v array<double>").groupBy("k").agg(*(F.sum(F.col("v")[j]).alias(f"c{j}") for j in range(block.shape[1])))
    total = np.zeros((out_rows, block.shape[1]))
    for row in parts.collect():
        total[row.k] = row[1:]
    return total / m.n


def orthogonal(block: np.ndarray, basis: np.ndarray, rng: np.random.Generator, most: int) -> np.ndarray:
    """Up to ``most`` orthonormal columns, orthogonal to ``basis``: of ``block``, then fresh ones for those that vanish."""
    dims, columns = basis.shape[0], []
    wanted = min(most, dims - basis.shape[1])
    candidates = [block[:, j] for j in range(block.shape[1])]
    while len(columns) < wanted:
        fresh = not candidates
        q = rng.standard_normal(dims) if fresh else candidates.pop(0)
        before = np.linalg.norm(q)
        against = np.column_stack([basis, *columns]) if columns or basis.shape[1] else None
        for _ in range(2 if against is not None else 0):
            q = q - against @ (against.T @ q)
        left = np.linalg.norm(q)
        if before == 0 or left <= 1e-10 * before:
            continue
        q = q / left
        if against is not None:
            q = q - against @ (against.T @ q)
            q = q / np.linalg.norm(q)
        columns.append(q)
    return np.column_stack(columns) if columns else np.zeros((dims, 0))


def leading_pairs(
    fit: DataFrame, m: Moments, count: int, *, block: int = 8, tolerance: float = 1e-14, most_basis: int = 512, most_passes: int = 1000, seed: int = 11
) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues, falling, and unit eigenvectors (as columns) of the fit rows' covariance.

    Fewer where fewer carry variance. Each is turned so that its largest entry is positive.
    """
    count = min(count, m.dims)
    block = max(block, count)
    most_basis = max(most_basis, 4 * block)
    rng = np.random.default_rng(seed)
    basis, images = np.zeros((m.dims, 0)), np.zeros((m.dims, 0))
    new = orthogonal(np.zeros((m.dims, 0)), basis, rng, block)
    values, vectors = np.zeros(0), np.zeros((m.dims, 0))
    for _ in range(most_passes):
        image = products(fit, m, new)
        basis, images = np.column_stack([basis, new]), np.column_stack([images, image])
        projected = basis.T @ images
        theta, s = np.linalg.eigh((projected + projected.T) / 2)
        theta, s = theta[::-1], s[:, ::-1]
        values, vectors = theta[:count], basis @ s[:, :count]
        residuals = np.linalg.norm(images @ s[:, :count] - vectors * values, axis=0)
        if basis.shape[1] == m.dims or (basis.shape[1] >= 2 * block and residuals.max(initial=0.0) <= tolerance * max(values[0], 0.0)):
            break
        new = orthogonal(image, basis, rng, block)
        if basis.shape[1] + block > most_basis:
            keep = s[:, : 2 * block]
            basis, images = basis @ keep, images @ keep
    values, vectors = values.copy(), vectors / np.linalg.norm(vectors, axis=0)
    good = values > 1e-12 * m.trace
    values, vectors = values[good], vectors[:, good]
    for j in range(vectors.shape[1]):
        if vectors[np.argmax(abs(vectors[:, j])), j] < 0:
            vectors[:, j] = -vectors[:, j]
    return values, vectors


def whitened(vectors: DataFrame, components: int = 4, *, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding", block: int = 8, tolerance: float = 1e-14) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error), a row for each vector and component."""
    schema = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark = vectors.sparkSession
    good = usable(vectors, id_col, vec_col)
    lengths = good.groupBy(F.size("v").alias("dims")).count().where("dims > 0").orderBy(F.desc("count"), "dims").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], schema)
    dims = lengths[0].dims
    good = good.where(F.size("v") == dims)
    fit, path = stored(fit_rows(good, scale))
    m = moments(fit, dims)
    values, axes = leading_pairs(fit, m, components, block=block, tolerance=tolerance) if m and m.deviation else (np.zeros(0), np.zeros((dims, 0)))
    if not len(values):
        discard(spark, path)
        return spark.createDataFrame([], schema)
    weights = axes / np.sqrt(values)
    explained = (values / m.trace).tolist()
    error = float(abs(products(fit, m, weights, square=True) - np.eye(len(values))).max())
    discard(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(explained)
        for b in batches:
            x = entries(b.column("v"), scale) if b.num_rows else np.zeros((0, dims), dtype=np.int64)
            ids = b.column("id").to_numpy(zero_copy_only=False)
            at = np.repeat(np.arange(len(x)), k)
            deviation = [d if d < 1 << 63 else None for d in m.deviations(x)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("id").take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(at), m.n, dtype=np.int64)), pa.array(deviation, pa.int64()).take(pa.array(at)),
                    pa.array((m.centred(x) @ weights).ravel() if len(ids) else np.zeros(0)),
                    pa.array(np.tile(np.array(explained), len(x))), pa.array(np.full(len(at), error)),
                ],
                names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return good.select(F.col("id").cast("long").alias("id"), "v").mapInArrow(run, schema)


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    """Query: four components of all ``embeddings``, entries in steps of 1/256."""
    return whitened(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")
