"""Whitening of embeddings by a pivoted Cholesky factor and one-sided Jacobi rotations.

Entries c become whole numbers ``x = floor(256 * c)``. The fit list is each distinct vector once: n vectors, sums S. The
covariance is ``(n * M - T * T') / n**2`` with M the products and T the sums of the vectors less a whole centre next to
S / n, added in whole numbers, so that neither the order of rows nor a large mean costs a digit. It is factored by Cholesky
with pivoting, which stops where the rest is rounding (the rank), and the columns of the triangular factor are rotated by
one-sided Jacobi until they are orthogonal: their squared norms are the eigenvalues, the columns scaled to length 1 and put
back in order are the components.

Vectors that are null or hold null or non-finite entries are dropped, and so are those of another length than most have (of
equally many, the longest). Repeated vectors count once and each row gets its result. Components beyond the rank do not
exist and have no rows: one distinct vector, or none, gives an empty result. Components with equal eigenvalues are any
orthonormal ones. ``deviation`` is null where it does not fit a long. Other columns are not read. Only sums of the size of
one covariance reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiregrain.llm.rows import require
from wiregrain.session import Scratch

#: Products of floats are added as such while their sum is below this, so exactly.
_EXACT = 2.0**52
#: Rest of the diagonal, against the largest entry at first, at which the factor ends.
_RANK = 1e-13
#: Rotations below this angle are none, and rounds of rotations at most.
_ANGLE = 1e-15
_SWEEPS = 60
#: Entries of a block of vectors.
_BLOCK = 1 << 20
_LONG = (1 << 63) - 1


@dataclass
class Whitening:
    """Whole centre and sums of the fit list, its size, and components (one a row) with their eigenvalues."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float


def whole_vectors(rows: DataFrame, key: str, vector: str, scale: int = 256) -> DataFrame:
    """(key, x) with whole numbers, without vectors that are null or hold null or non-finite entries."""
    entries = F.transform("v", lambda c: c.cast("double"))
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    own = require(rows, key, vector).toDF("key", "v").select("key", entries.alias("v")).filter(F.col("v").isNotNull()).filter(fine)
    return own.select("key", F.transform("v", lambda c: F.floor(c * scale)).alias("x"))


def _same_length(rows: DataFrame) -> tuple[DataFrame, int]:
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    width = sizes.d if sizes else 0
    return rows.filter(F.size("x") == width), width


def _blocks(batches: Iterator[pa.RecordBatch], width: int, column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    step = max(_BLOCK // max(width, 1), 1)
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield part, part.column(column).flatten().to_numpy().reshape(-1, width)


def _sums(vectors: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number and sums of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * width
        for _, x in _blocks(batches, width, "x"):
            n += len(x)
            # Halves of 32 bits, so that no sum of a block overflows.
            high, low = (x >> 32).sum(axis=0).tolist(), (x & 0xFFFFFFFF).sum(axis=0).tolist()
            total = [t + (h << 32) + w for t, h, w in zip(total, high, low, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, width), pa.int32()), pa.array([str(v) for v in (n, *total)])], ["at", "sum"])

    found = vectors.mapInArrow(run, "at int, sum string").groupBy("at").agg(F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum"))
    by_place = {r["at"]: int(r["sum"]) for r in found.collect()}
    return by_place.get(-1, 0), [by_place.get(i, 0) for i in range(width)]


def _products(vectors: DataFrame, width: int, centre: list[int]) -> list[list[int]]:
    """Sums of products of the vectors less the centre, row by row, as whole numbers."""
    middle = np.array(centre, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width), object)
        for _, x in _blocks(batches, width, "x"):
            y = x - middle
            largest = float(np.abs(y.astype(float)).max(initial=0.0))
            if largest**2 * len(y) < _EXACT:
                own = y.astype(float)
                total += (own.T @ own).astype(np.int64).astype(object)
            else:
                own = y.astype(object)
                total += own.T @ own
        rows = [[str(v) for v in r] for r in total.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(rows, pa.list_(pa.string()))], ["i", "sums"])

    found = vectors.mapInArrow(run, "i int, sums array<string>").select("i", F.posexplode("sums").alias("j", "v")).groupBy("i", "j")
    out = [[0] * width for _ in range(width)]
    for r in found.agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).toLocalIterator():
        out[r.i][r.j] = int(r.v)
    return out


def cholesky(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Factor L (one column for each rank) and order p with ``matrix[p][:, p] = L @ L.T``; the largest rest is next."""
    rest = matrix.astype(float).copy()
    order = np.arange(len(rest))
    factor = np.zeros_like(rest)
    limit = _RANK * max(rest.diagonal().max(initial=0.0), 0.0)
    for k in range(len(rest)):
        at = k + int(np.argmax(rest.diagonal()[k:]))
        if rest[at, at] <= limit:
            return factor[:, :k], order
        for whole in (rest, rest.T, factor):
            whole[[k, at]] = whole[[at, k]]
        order[[k, at]] = order[[at, k]]
        factor[k:, k] = rest[k:, k] / np.sqrt(rest[k, k])
        rest[k + 1 :, k + 1 :] -= np.outer(factor[k + 1 :, k], factor[k + 1 :, k])
    return factor, order


def jacobi(factor: np.ndarray) -> np.ndarray:
    """The factor times rotations that make its columns orthogonal, longest first."""
    a = factor.copy()
    for _ in range(_SWEEPS):
        turned = False
        for p in range(a.shape[1] - 1):
            for q in range(p + 1, a.shape[1]):
                x, y = a[:, p], a[:, q]
                alpha, beta, gamma = x @ x, y @ y, x @ y
                if abs(gamma) <= _ANGLE * np.sqrt(alpha * beta):
                    continue
                turned = True
                zeta = (beta - alpha) / (2 * gamma)
                t = (1.0 if zeta >= 0 else -1.0) / (abs(zeta) + np.hypot(1.0, zeta))
                c = 1 / np.hypot(1.0, t)
                a[:, p], a[:, q] = c * x - c * t * y, c * t * x + c * y
        if not turned:
            break
    return a[:, np.argsort(-(a * a).sum(axis=0), kind="stable")]


def fit(vectors: DataFrame, width: int) -> Whitening:
    """Components of distinct whole vectors (x) of one length."""
    n, sums = _sums(vectors, width)
    if not n:
        return Whitening(0, sums, np.empty((0, width)), np.empty(0), 0.0)
    centre = [(2 * s + n) // (2 * n) for s in sums]
    products = _products(vectors, width, centre)
    rest = [s - n * c for s, c in zip(sums, centre, strict=True)]
    covariance = np.array([[(n * m - a * b) / n**2 for m, b in zip(row, rest, strict=True)] for row, a in zip(products, rest, strict=True)], float).reshape(width, width)
    factor, order = cholesky(covariance)
    turned = jacobi(factor)
    eigenvalues = (turned * turned).sum(axis=0)
    components = np.zeros_like(turned.T)
    components[:, order] = (turned / np.sqrt(eigenvalues)).T
    return Whitening(n, sums, components, eigenvalues, float(np.trace(covariance)))


def _whitened(rows: DataFrame, model: Whitening, most: int) -> DataFrame:
    """(key, x) to (key, deviation, w): the first components of every vector."""
    k = min(most, len(model.eigenvalues))
    n, sums = model.n, model.sums
    whole, part = [s // n for s in sums], [(s % n) / n for s in sums]
    axes = (model.components[:k] / np.sqrt(model.eigenvalues[:k])[:, None]).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _blocks(batches, len(sums), "x"):
            y = x - np.array(whole, np.int64)
            w = (y.astype(float) - np.array(part)) @ axes
            # n * x - S = n * y - (S mod n), in whole numbers.
            left = np.array([s % n for s in sums], object)
            if float(np.abs(y.astype(float)).max(initial=0.0) + 1) * n < 2.0**31 / np.sqrt(max(len(sums), 1)):
                deviation = ((n * y - left.astype(np.int64)) ** 2).sum(axis=1).tolist()
            else:
                deviation = [int(v) for v in ((n * y.astype(object) - left) ** 2).sum(axis=1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([v if v <= _LONG else None for v in deviation], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) * k + 1, k), pa.int32()), pa.array(np.ascontiguousarray(w).reshape(-1))),
                ],
                ["key", "deviation", "w"],
            )

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, deviation long, w array<double>")


def whiten(rows: DataFrame, scratch: Scratch, key: str = "vec_id", vector: str = "embedding", components: int = 4) -> DataFrame:
    """For each row and component: key, component, n, deviation, whitened, explained, identity_error.

    ``identity_error`` is the largest absolute entry of the covariance of the fit list's whitened values minus the identity.
    """
    own, width = _same_length(whole_vectors(rows, key, vector))
    kind = own.schema["key"].dataType.simpleString()
    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not width:
        return rows.sparkSession.createDataFrame([], schema)
    distinct = scratch.settle(own.select("x").distinct())
    model = fit(distinct, width)
    k = min(components, len(model.eigenvalues))
    if not k:
        return rows.sparkSession.createDataFrame([], schema)
    seen = _whitened(distinct.select(F.lit(0).alias("key"), "x"), model, k).select(*[F.col("w")[i].alias(f"w{i}") for i in range(k)])
    # covar_pop takes means off before it multiplies.
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    found = seen.agg(*[F.covar_pop(f"w{i}", f"w{j}") for i, j in pairs]).first()
    error = max(abs(v - (i == j)) for v, (i, j) in zip(found, pairs, strict=True))
    explained = F.array(*[F.lit(float(e / model.trace)) for e in model.eigenvalues[:k]])
    out = _whitened(own, model, k).select("key", "deviation", F.posexplode("w").alias("at", "whitened"))
    return out.select(
        F.col("key").alias(key),
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        explained[F.col("at")].alias("explained"),
        F.lit(float(error)).alias("identity_error"),
    )
