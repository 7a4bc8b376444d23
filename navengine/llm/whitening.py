"""Whitening of embeddings from an exact scatter matrix, gathered in residues of several primes.

Entries become integers. Each partition multiplies its centred rows in modular matrix products, one for
each prime, in doubles that stay whole numbers; Spark sums the residues over partitions, and Chinese remaindering makes
the exact scatter matrix of the sums. So it does not depend on how rows are partitioned, and no digit
is lost before the eigenvectors are taken in double precision.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table
from .topk_search import usable, weights

ROWS = 4096  # residues are below 2**20, so the sum of so many products is below 2**53


def primes(bound: int) -> list[int]:
    """Primes under 2**21, so many that their product is above 2 * bound + 1."""
    out, x = [], (1 << 21) - 1
    while prod(out) <= 2 * bound + 1:
        if all(x % q for q in range(3, 1449, 2)):
            out.append(x)
        x -= 2
    return out


def residues(x: np.ndarray, p: int) -> np.ndarray:
    """Residues of smallest size."""
    r = x % p
    return np.where(r > p // 2, r - p, r)


def product(x: np.ndarray, p: int) -> np.ndarray:
    """x'x modulo p, through doubles without rounding."""
    out = np.zeros((x.shape[1],) * 2, np.int64)
    for lo in range(0, len(x), ROWS):
        r = residues(x[lo : lo + ROWS], p).astype(np.float64)
        out = (out + (r.T @ r).astype(np.int64)) % p
    return out


def remainder(parts: dict[int, np.ndarray]) -> np.ndarray:
    """The integers of smallest size with these residues, as Python's integers."""
    whole, out = prod(parts), 0
    for p, r in parts.items():
        rest = whole // p
        out = out + r.astype(object) * (rest * pow(rest, -1, p))
    out = out % whole
    return np.where(out > whole // 2, out - whole, out)


def _rows(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return np.asarray(batch.column("x").flatten(), np.int64).reshape(-1, dims)


def _summed(fit: DataFrame, of: list[int], shape: tuple[int, ...], part: Callable[[np.ndarray, int], np.ndarray]) -> np.ndarray:
    """The exact sum of ``part`` over the rows of ``fit``; only dims or dims * dims residues for each prime reach the driver."""
    dims = shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for b in batches:
            x = _rows(b, dims)
            new = [part(x, p) % p for p in of]
            sums = new if sums is None else [(a + c) % p for a, c, p in zip(sums, new, of, strict=True)]
        for p, s in zip(of, sums or [], strict=False):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(s.size, p)), pa.array(np.arange(s.size)), pa.array(s.ravel())], names=["p", "at", "r"])

    got = fit.select("x").mapInArrow(run, "p bigint, at bigint, r bigint").groupBy("p", "at").agg((F.sum("r") % F.col("p")).alias("r")).toArrow()
    p, at, r = (got.column(c).to_numpy() for c in ("p", "at", "r"))
    parts = {q: np.zeros(shape, np.int64) for q in of}
    for q, out in parts.items():
        out.ravel()[at[p == q]] = r[p == q]
    return remainder(parts)


def _centred(x: np.ndarray, n: int, sums: np.ndarray, wide: bool) -> np.ndarray:
    """n * x - sums, exactly; in Python's integers if 64 bits do not do."""
    return x.astype(object) * n - sums if wide else x * n - sums.astype(np.int64)


def whiten(rows: DataFrame, k: int = 4, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """id, component, n, deviation, whitened, explained, identity_error: each row's projections on the ``k`` largest components.

    An entry c counts as floor(scale * c). The mean and the covariance are those of the distinct
    vectors (n of them, divisor n). Rows whose vector is null or holds null or non-finite entries go;
    a row with a null id stays. Repeated rows each get their result. A shorter vector counts as if it ended in zeros.
    Components are numbered from 1 by falling variance; those whose variance is zero to double
    precision are left out, so equal vectors and an empty table give no rows. deviation is the exact sum of
    squares of n * x - S (S: sums over the n vectors); an error if no 64-bit integer holds it. Of columns beside id
    and vector none is read. The driver gets sums of the size of dims * dims, never rows.
    """
    good = rows.select(F.col(id_col), F.col(vector_col).alias("__nav_v")).where(usable(F.col("__nav_v")))
    dims = good.agg(F.max(F.size("__nav_v"))).first()[0] or 0
    x = weights(F.col("__nav_v"), scale)
    x = F.when(F.size(x) < dims, F.concat(x, F.array_repeat(F.lit(0).cast("long"), dims - F.size(x)))).otherwise(x)
    whole = good.select(F.col(id_col), x.alias("x"))
    id_type = whole.schema[0].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    fit = materialize(whole.select("x").distinct(), "fit")
    n, low, high = fit.agg(F.count(F.lit(1)), F.min(F.array_min("x")), F.max(F.array_max("x"))).first()
    if not n or not dims:
        return rows.sparkSession.createDataFrame([], schema)
    largest = max(abs(low), abs(high))
    sums = _summed(fit, primes(n * largest), (dims,), lambda v, p: (v % p).sum(0))
    of = primes(n * (2 * n * largest) ** 2)

    def scatter(v: np.ndarray, p: int) -> np.ndarray:
        return product((v % p) * (n % p) - (sums % p).astype(np.int64), p)

    exact = _summed(fit, of, (dims, dims), scatter)  # n**3 times the covariance
    covariance = (exact / n**3).astype(np.float64)
    e, vectors = np.linalg.eigh(covariance)
    e, vectors = e[::-1], vectors[:, ::-1]
    k = min(k, int((e > e[0] * dims * 2.0**-52).sum())) if e[0] > 0 else 0
    if not k:
        return rows.sparkSession.createDataFrame([], schema)
    axes = vectors[:, :k] / np.sqrt(e[:k])
    explained = e[:k] / float(np.trace(exact) / n**3)
    wide = 2 * n * largest >= 1 << 62

    def project(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y = _centred(v, n, sums, wide)
        return y, (y / n).astype(np.float64) @ axes

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for b in batches:
            z = project(_rows(b, dims))[1]
            total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array(total.ravel())], names=["at", "s"])

    got = fit.mapInArrow(squares, "at bigint, s double").groupBy("at").agg(F.sum("s").alias("s")).toArrow()
    unit = np.zeros(k * k)
    unit[got.column("at").to_numpy()] = got.column("s").to_numpy() / n
    error = float(np.abs(unit.reshape(k, k) - np.eye(k)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y, z = project(_rows(b, dims))
            if wide or int(np.abs(y).max(initial=0)) ** 2 * dims >= 1 << 63:
                y = y.astype(object)
            d = pa.array((y * y).sum(1).tolist(), pa.int64())  # an OverflowError if it is too large
            m = len(z)
            every = np.repeat(np.arange(m), k)
            columns = [b.column(0).take(pa.array(every)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), d.take(pa.array(every)), pa.array(z.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return whole.mapInArrow(run, schema)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
