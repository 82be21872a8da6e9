"""Whitening of embedding columns by polarisation: covariances from exact variances alone.

Entries become integers, so that sums of squares are exact at any size. With z = n*x - S, the
values centred and scaled by the number of vectors, tasks sum z_i^2 of every dimension and
(z_i + z_j)^2 of every pair of dimensions; half of the difference of the pair's sum and the two
single ones is the cross-covariance. The driver gets one number for each pair of dimensions,
however many vectors there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Context, Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import Scratch

#: An entry c counts as floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Scaled entries count up to here, so that they fit a long.
LARGEST = 2.0**52
#: Rows whose pair sums are made at once, and bits of the limbs in which they are squared.
ROWS, LIMB = 2048, 20
#: Share of the largest eigenvalue below which a direction has no spread to be scaled.
NO_SPREAD = 1e-11
_WIDE = Context(prec=60)


@dataclass
class Whitening:
    """n vectors with sums S, centred and projected on unit ``vectors`` (a column each) over the root of ``values``."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray


def whole(col: Column, dims: int | None = None) -> Column:
    """The integers of a vector; null where it or an entry is null or not finite. Up to ``dims`` missing entries count as 0."""
    entries = F.transform(col, lambda c: c.cast("double"))
    told = col.isNotNull() & F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    filled = entries if dims is None else F.concat(entries, F.array_repeat(F.lit(0.0), F.lit(dims) - F.size(entries)))
    return F.when(told, F.transform(filled, lambda c: F.floor(F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), c * SCALE))).cast("long") + SHIFT))


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(len(column), dims)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n*x - S as long, or as Python integers where it may not fit."""
    if x.size and n * max(abs(int(x.max())), abs(int(x.min())), 1) + max(map(abs, sums), default=0) >= 2**61:
        return x.astype(object) * n - np.array(sums, object)
    return x * n - np.array(sums, np.int64)


def _squares(w: np.ndarray) -> list[int]:
    """The exact sum of squares of each column."""
    if w.dtype == object:
        return [int(v) for v in (w * w).sum(0)]
    low = np.abs(w)
    limbs = []
    while True:
        limbs.append(low & ((1 << LIMB) - 1))
        low = low >> LIMB
        if not low.any():
            break
    total = [0] * w.shape[1]
    for i, a in enumerate(limbs):
        for j, b in enumerate(limbs[i:], i):
            # at most 2**12 rows of products under 2**40
            for k, v in enumerate(np.einsum("rk,rk->k", a, b).tolist()):
                total[k] += (v << (LIMB * (i + j))) * (1 + (i != j))
    return total


def _sums(dims: int):
    """(i, total) of the entries of each dimension, for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * dims
        for batch in batches:
            x = _matrix(batch.column(0), dims)
            for at in range(0, len(x), 1 << 16):
                part = x[at : at + (1 << 16)]
                total = [t + (int(hi) << 31) + int(lo) for t, hi, lo in zip(total, (part >> 31).sum(0), (part & (2**31 - 1)).sum(0), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))], names=["i", "total"])

    return run


def _spreads(dims: int, n: int, sums: list[int]):
    """(i, j, total): squares of z_i where j is i, else of z_i + z_j, summed exactly over a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [[0] * (dims - i) for i in range(dims)]
        for batch in batches:
            x = _matrix(batch.column(0), dims)
            for at in range(0, len(x), ROWS):
                z = _centred(x[at : at + ROWS], n, sums)
                for i in range(dims):
                    both = np.concatenate([z[:, i : i + 1], z[:, i : i + 1] + z[:, i + 1 :]], axis=1)
                    total[i] = [t + s for t, s in zip(total[i], _squares(both), strict=True)]
        i, j = [i for i in range(dims) for _ in range(i, dims)], [j for i in range(dims) for j in range(i, dims)]
        flat = [_WIDE.create_decimal(t) for row in total for t in row]
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(flat, pa.decimal128(38, 0))], names=["i", "j", "total"])

    return run


def polarised(dims: int, n: int, totals: dict[tuple[int, int], int]) -> np.ndarray:
    """The covariance matrix from sums of squares of single dimensions and of sums of two; each entry is rounded once."""
    out = np.zeros((dims, dims))
    for (i, j), t in totals.items():
        exact = Fraction(t, n**3) if i == j else Fraction(t - totals[i, i] - totals[j, j], 2 * n**3)
        out[i, j] = out[j, i] = float(exact)
    return out


def fit_whitening(fit: DataFrame, dims: int, most: int = 16) -> Whitening:
    """The whitening of the distinct integer vectors ``fit`` (x array<long> of length ``dims``), up to ``most`` components.

    Eigenvectors have their largest entry positive, so that runs agree. With no vectors or no
    dimensions there are no components.
    """
    n = fit.count()
    if not n or not dims:
        return Whitening(n, [0] * dims, np.zeros(0), np.zeros((dims, 0)), np.zeros(0))
    of = {r["i"]: int(r["s"]) for r in fit.select("x").mapInArrow(_sums(dims), "i int, total decimal(38,0)").groupBy("i").agg(F.sum("total").alias("s")).collect()}
    sums = [of[i] for i in range(dims)]
    spread = fit.select("x").mapInArrow(_spreads(dims, n, sums), "i int, j int, total decimal(38,0)").groupBy("i", "j").agg(F.sum("total").alias("s"))
    v = polarised(dims, n, {(r["i"], r["j"]): int(r["s"]) for r in spread.collect()})
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    top = np.abs(vectors).argmax(0)
    vectors = vectors * np.where(vectors[top, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    trace = float(np.trace(v))
    return Whitening(n, sums, values, np.ascontiguousarray(vectors), values / trace if trace else np.full(len(values), np.nan))


def _projected(z: np.ndarray, fitted: Whitening) -> np.ndarray:
    """Whitened values of centred rows; NaN where a direction has no spread."""
    scale = np.where(fitted.values > NO_SPREAD * max(float(fitted.values[0]), 0.0), fitted.values, np.nan) if len(fitted.values) else fitted.values
    return (np.asarray(z / fitted.n, float) @ fitted.vectors) / np.sqrt(scale)


def _moments(dims: int, fitted: Whitening):
    """(i, j, total): products of whitened values, centred in each batch, and what its means add to them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(fitted.values)
        total, first = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            x = _matrix(batch.column(0), dims)
            for at in range(0, len(x), 1 << 14):
                w = _projected(_centred(x[at : at + (1 << 14)], fitted.n, fitted.sums), fitted)
                mean = w.mean(0)
                total += (w - mean).T @ (w - mean) + len(w) * np.outer(mean, mean)
                first += w.sum(0)
        i, j = np.divmod(np.arange(size * size), max(size, 1))
        i, j = np.concatenate([i, np.arange(size)]), np.concatenate([j, np.full(size, -1)])
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(np.concatenate([total.ravel(), first]))], names=["i", "j", "total"])

    return run


def identity_error(fit: DataFrame, dims: int, fitted: Whitening) -> float | None:
    """The largest absolute entry of the whitened vectors' covariance minus the identity; directions without spread have none."""
    if not len(fitted.values):
        return None
    rows = fit.select("x").mapInArrow(_moments(dims, fitted), "i int, j int, total double").groupBy("i", "j").agg((F.sum("total") / fitted.n).alias("m")).collect()
    m = {(r["i"], r["j"]): r["m"] for r in rows}
    off = [abs(v - m[i, -1] * m[j, -1] - (i == j)) for (i, j), v in m.items() if j >= 0]
    off = [x for x in off if x == x]
    return max(off, default=None)


def _apply(dims: int, fitted: Whitening):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                z = _centred(_matrix(part.column(1), dims), fitted.n, fitted.sums)
                w = _projected(z, fitted)
                if z.dtype != object and (not z.size or dims * int(np.abs(z).max()) ** 2 < 2**63):
                    deviation = [int(v) for v in (z * z).sum(1)]
                else:
                    deviation = [int(v) for v in (z.astype(object) ** 2).sum(1)]
                fits = pa.array([d if d < 2**63 else None for d in deviation], pa.int64())
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), fits, values], names=["id", "deviation", "whitened"])

    return run


def whiten(df: DataFrame, id_col: str, vector_col: str, most: int = 16) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component.

    Rows whose vector is null or holds a null or non-finite entry leave. The fit is over the
    distinct integer vectors, so copies weigh once. Vectors shorter than the longest count as 0
    at their end, also empty ones. A direction without spread (copies alone, or fewer vectors
    than dimensions) has a null whitened value and does not count in ``identity_error``;
    ``deviation`` is null where it is beyond a long. Ids may be null, repeat and be of any
    type; rows are each whitened. An empty table gives no rows; other columns are not read.
    """
    scratch = Scratch(df.sparkSession, "whitening")
    dims = int(df.select(F.max(F.size(whole(F.col(vector_col)))).alias("d")).first()["d"] or 0)
    rows = df.select(F.col(id_col).alias("id"), whole(F.col(vector_col), dims).alias("x")).where("x is not null")
    fit = scratch.table(rows.select("x").distinct(), "fit")
    fitted = fit_whitening(fit, dims, most)
    error = identity_error(fit, dims, fitted)
    told = f"id {df.schema[id_col].dataType.simpleString()}, deviation long, whitened array<double>"
    out = rows.mapInArrow(_apply(dims, fitted), told).select("id", "deviation", F.posexplode("whitened").alias("k", "w"))
    explained = F.element_at(F.array(*(F.lit(float(e)) for e in fitted.explained)), F.col("k") + 1) if len(fitted.explained) else F.lit(None).cast("double")
    return out.select(
        F.col("id").alias(id_col), (F.col("k") + 1).alias("component"), F.lit(fitted.n).cast("long").alias("n"), "deviation",
        F.nanvl("w", F.lit(None).cast("double")).alias("whitened"), F.nanvl(explained, F.lit(None).cast("double")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
