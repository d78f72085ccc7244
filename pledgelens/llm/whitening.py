"""Embedding whitening by Chebyshev-filtered subspace iteration.

Vectors become integers, floor(scale * x). The fit list holds each different integer vector once, packed into blocks of
bounded size in a table of the shared folder. The covariance V is never formed: each pass over the blocks computes V*Q for
a few columns Q as the sum of centred products C'(C*Q) / n, and only such sums (dim x columns) reach the driver, through
a tree of about the square root of the blocks. A round is
1. a Chebyshev polynomial of V on Q, one pass for each degree, that stays small over an interval up to the smallest Ritz value
   of the block and grows steeply above it, so that the unwanted part of the spectrum is damped. The interval begins as far
   below the mean of the eigenvalues outside the block (known from the trace) as it ends above, or at 0 as soon as a Ritz
   value shows that something lies further below, which such a filter would bring up;
2. QR, one more pass, and Rayleigh-Ritz;
3. the certificate: |V*q - e*q| <= tolerance * e_1 for every wanted column.
Rounds end with the certificate. A block of columns that makes no headway is widened, and one that spans all dimensions is
solved by its Rayleigh-Ritz step, so the iteration ends for any spectrum. Counts, sums and the trace are exact integers.

Edge cases: vectors that are null, empty, or hold null or non-finite components take no part; of several lengths the most
common one counts (of equally common ones the longest), the others take no part; null and repeated ids stay rows of their
own; equal vectors are fitted once and whitened alike; components whose variance is zero beside the trace (1e-12) are left
out, so one vector alone has none; extra columns stay, only a column named `whitened` is replaced; an empty table gives an
empty table. Components beyond 2**40 after scaling raise an error.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pledgelens.llm.common import by_value, materialise
from pledgelens.llm.native import free_names

by_value(__name__)

BLOCK_BYTES = 8 << 20
#: Bytes of partial sums that may come to the driver without a tree.
DIRECT_BYTES = 32 << 20
LARGEST = 2.0**40
ZERO = 1e-12


@dataclass(frozen=True)
class Whitening:
    """What was fitted: vectors are columns, largest variance first."""

    dim: int
    scale: int
    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    residual: float
    identity_error: float
    passes: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def explained(self) -> list[float]:
        return [float(e / self.trace) for e in self.values]


def usable(vector: str) -> Column:
    """Whether a vector is there with all of its components, each finite."""
    whole = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(whole & (F.size(vector) > 0), F.lit(False))


def as_integers(vector: str, scale: int) -> Column:
    """array<bigint> of floor(scale * component)."""
    beyond = F.raise_error(F.lit("a scaled component is beyond 2**40")).cast("bigint")

    def one(v: Column) -> Column:
        scaled = v.cast("double") * scale
        return F.when(F.abs(scaled) < LARGEST, F.floor(scaled)).otherwise(beyond)

    return F.transform(vector, one)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def pack(vectors: DataFrame, dim: int) -> DataFrame:
    """Blocks of whole vectors, each in the narrowest integer type that holds it: (kind, vals)."""
    rows = max(1, BLOCK_BYTES // (8 * dim))

    def block(parts: list[np.ndarray]) -> pa.RecordBatch:
        x = np.concatenate(parts)
        kind = next(k for k in ("i2", "i4", "i8") if np.abs(x).max() <= np.iinfo(k).max)
        return pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([x.astype(kind).tobytes()], pa.binary())], ["kind", "vals"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            for at in range(0, len(x), rows):
                part = x[at : at + rows]
                if n + len(part) > rows and held:
                    yield block(held)
                    held, n = [], 0
                held.append(part)
                n += len(part)
        if n:
            yield block(held)

    return vectors.mapInArrow(run, "kind string, vals binary")


def _add(a: list, b: list) -> list:
    return [x + y for x, y in zip(a, b, strict=True)]


def gather(blocks: DataFrame, count: int, dim: int, size: int, kernel: Callable[[np.ndarray], list]) -> list:
    """The sum over all blocks of what `kernel` makes of each (a list of arrays or numbers, about `size` bytes)."""

    def summed(parts):
        total = None
        for p in parts:
            total = p if total is None else _add(total, p)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], ["part"])

    def per_task(batches):
        rows = ((kind, vals) for b in batches for kind, vals in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        yield from summed(kernel(np.frombuffer(vals, kind).reshape(-1, dim)) for kind, vals in rows)

    def per_branch(batches):
        yield from summed(pickle.loads(p) for b in batches for p in b.column(0).to_pylist())

    parts = blocks.mapInArrow(per_task, "part binary")
    if count * size > DIRECT_BYTES:
        parts = parts.repartition(math.isqrt(count) + 1).mapInArrow(per_branch, "part binary")
    return reduce(_add, (pickle.loads(r.part) for r in parts.collect()))


def integer_sums(x: np.ndarray) -> list:
    """Rows, and sums and sums of squares of each column as Python integers."""
    wide = x.astype(np.int64)
    squares = (wide * wide).sum(axis=0).astype(object) if np.abs(wide).max() < 2**20 else (wide.astype(object) ** 2).sum(axis=0)
    return [len(x), wide.sum(axis=0).astype(object), squares]


def filtered(apply: Callable[[np.ndarray], np.ndarray], q: np.ndarray, vq: np.ndarray, degree: int, low: float, high: float, top: float) -> np.ndarray:
    """A Chebyshev polynomial of V on Q, small over [low, high], scaled so that it is about one at `top`."""
    half, middle = (high - low) / 2, (high + low) / 2
    sigma = first = half / (top - middle)
    now = (vq - middle * q) * (sigma / half)
    for _ in range(degree - 1):
        following = 1 / (2 / first - sigma)
        q, now = now, 2 * following / half * (apply(now) - middle * now) - sigma * following * q
        sigma = following
    return now


def leading(apply: Callable[[np.ndarray], np.ndarray], dim: int, wanted: int, width: int = 16, degree: int = 10, tolerance: float = 1e-13, trace: float = 0.0) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues (falling), eigenvectors and the largest residual over the largest eigenvalue, of an operator Q -> V*Q."""
    rng = np.random.default_rng(11)
    width, stalled, last, low, whole = min(dim, max(width, 2 * wanted)), 0, math.inf, 0.0, False
    q = np.linalg.qr(rng.standard_normal((dim, width)))[0]
    while True:
        vq = apply(q)
        h = q.T @ vq
        values, turn = np.linalg.eigh((h + h.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        top = values[0]
        residual = float(np.linalg.norm(vq - q * values, axis=0)[:wanted].max() / top) if top > 0 else 0.0
        if residual <= tolerance or width == dim:
            return values[:wanted], q[:, :wanted], residual
        stalled = stalled + 1 if residual > last / 2 else 0
        last = min(last, residual)
        high = max(values[-1], top * 1e-6)
        whole = whole or bool(values[-1] < low)
        rest = (trace - values.sum()) / (dim - width)
        low = 0.0 if whole else max(0.0, min(2 * rest - high, 0.999 * high))
        y = filtered(apply, q, vq, degree, low, high, top) if high < top * (1 - 1e-9) else vq
        if stalled >= 3:  # more columns, so that a larger gap decides
            width, stalled = min(dim, 2 * width), 0
            y = np.hstack([y / np.linalg.norm(y, axis=0), rng.standard_normal((dim, width - q.shape[1]))])
        q = np.linalg.qr(y)[0]


def fit_whitening(df: DataFrame, components: int = 4, *, scale: int = 256, vector_col: str = "embedding", width: int = 16, degree: int = 10, tolerance: float = 1e-13) -> Whitening | None:
    """The leading components of the different usable vectors; None where there is none."""
    rows = df.where(usable(vector_col)).select(F.col(vector_col).alias("vector"))
    common = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if common is None:
        return None
    dim = common["dim"]
    distinct = rows.where(F.size("vector") == dim).select(as_integers("vector", scale).alias("x")).distinct()
    blocks = materialise(pack(distinct, dim))
    count, passes = blocks.count(), 0
    n, sums, squares = gather(blocks, count, dim, 32 * dim, integer_sums)
    mean = np.array([s / n for s in sums])
    trace = sum(n * q - s * s for s, q in zip(sums, squares, strict=True)) / (n * n)

    def apply(q: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1

        def product(x: np.ndarray) -> list:
            centred = x - mean
            return [centred.T @ (centred @ q)]

        return gather(blocks, count, dim, 8 * q.size, product)[0] / n

    values, vectors, residual = leading(apply, dim, min(components, dim), width, degree, tolerance, trace)
    kept = values > ZERO * trace
    values, vectors = values[kept], vectors[:, kept]
    error = 0.0
    if len(values):
        to = vectors / np.sqrt(values)

        def products(x: np.ndarray) -> list:
            white = (x - mean) @ to
            return [white.sum(axis=0), white.T @ white]

        total, square = gather(blocks, count, dim, 8 * len(values) ** 2, products)
        error = float(np.abs(square / n - np.outer(total / n, total / n) - np.eye(len(values))).max())
    return Whitening(dim, scale, n, [int(s) for s in sums], trace, values, vectors, residual, error, passes)


def whiten(df: DataFrame, model: Whitening | None, *, vector_col: str = "embedding") -> DataFrame:
    """The rows that take part, with `whitened`: array<double>, each component's projection over its deviation."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = df.drop("whitened")
    schema = T.StructType([*kept.schema, T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    if model is None:
        return kept.where(F.lit(False)).withColumn("whitened", F.lit(None).cast("array<double>"))
    (x,) = free_names(kept, "x")
    rows = kept.where(usable(vector_col)).where(F.size(vector_col) == model.dim).withColumn(x, as_integers(vector_col, model.scale))
    mean, to, dim = model.mean, model.vectors / np.sqrt(model.values), model.dim
    names = to_arrow_schema(schema).names

    def run(batches):
        for b in batches:
            white = (_matrix(b.column(b.num_columns - 1), dim) - mean) @ to
            offsets = pa.array(np.arange(len(white) + 1) * white.shape[1], pa.int32())
            made = pa.ListArray.from_arrays(offsets, pa.array(white.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], made], names)

    return rows.mapInArrow(run, schema)
