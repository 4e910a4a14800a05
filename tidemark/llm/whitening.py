"""Whitening of integer embeddings: exact scatter by residues, then a double eigendecomposition.

Vectors become integers.  Each partition multiplies its matrix with itself modulo several primes, in doubles that stay below
2^53, so every step is exact.  Residues are summed over partitions, a row of the matrix at a time, and Chinese remaindering
gives the sums themselves: the scatter is exact however large the mean is beside the deviations.  Only that
matrix, of the vectors' dimension, reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import cut, slices

#: An entry c becomes floor(SCALE * c).
SCALE = 256
COMPONENTS = 4
#: Primes lie below 2^20: sums of 2^12 products stay below 2^52.
PRIME_BITS = 20
GEMM_ROWS = 1 << 12
#: Rows that are scored at once.
SCORE_ROWS = 4096
MOST = (1 << 63) - 1


def primes(product: int) -> list[int]:
    """The largest primes below 2^20, as many as have a product above ``product``."""
    sieve = np.ones(1 << PRIME_BITS, dtype=bool)
    sieve[:2] = False
    for p in range(2, 1 << PRIME_BITS // 2):
        if sieve[p]:
            sieve[p * p :: p] = False
    found, reached = [], 1
    for p in np.flatnonzero(sieve)[::-1].tolist():
        if reached > product:
            break
        found.append(p)
        reached *= p
    return found


def remaindered(residues: np.ndarray, moduli: list[int]) -> list[int]:
    """The integers nearest zero that have these residues; a row of residues for each modulus."""
    whole = math.prod(moduli)
    total = np.zeros(residues.shape[1], dtype=object)
    for p, row in zip(moduli, residues, strict=True):
        rest = whole // p
        total = (total + row.astype(object) * (rest * pow(rest, -1, p))) % whole
    return [x - whole if 2 * x > whole else x for x in total.tolist()]


def matrix(column: pa.Array) -> np.ndarray:
    """Equally long arrays of integers as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def largest(x: np.ndarray) -> int:
    """The largest absolute value, also where that is no int64."""
    return max(int(x.max(initial=0)), -int(x.min(initial=0)))


def integer_vectors(rows: DataFrame, embedding: str = "embedding") -> DataFrame:
    """rows with ``x``, the vector in integers; rows whose vector is null, empty, or has null or non-finite entries go.

    An entry beyond the range of a long becomes its end.
    """
    c = F.col(f"`{embedding}`").cast("array<double>")
    odd = F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return rows.where((F.size(c) > 0) & ~odd).withColumn("x", F.transform(c, lambda v: F.floor(v * SCALE)))


def exact_scatter(vectors: DataFrame, dimension: int, bound: int) -> tuple[list[int], list[list[int]]]:
    """The sums of the vectors ``x`` of a DataFrame, and of their products: exact.  ``bound`` is at least what their absolute values reach."""
    moduli = primes(2 * bound)
    width = dimension + 1

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(moduli), dimension, width), dtype=np.int64)
        any_row = False
        for batch in slices(batches, GEMM_ROWS):
            if not batch.num_rows:
                continue
            any_row = True
            x = matrix(batch.column(0))
            for k, p in enumerate(moduli):
                r = np.mod(x, p).astype(np.float64)
                sums[k, :, :dimension] += (r.T @ r).astype(np.int64) % p
                sums[k, :, dimension] += r.sum(axis=0).astype(np.int64) % p
                sums[k] %= p
        if any_row:
            for i in range(dimension):
                yield pa.record_batch([pa.array([i], pa.int32()), pa.array([sums[:, i].ravel()])], names=["i", "residues"])

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, row in zip(batch.column(0).to_pylist(), matrix(batch.column(1)) if batch.num_rows else (), strict=True):
                held[i] = (held.get(i, 0) + row.reshape(len(moduli), width)) % np.array(moduli)[:, None]
        for i, row in held.items():
            yield pa.record_batch([pa.array([i], pa.int32()), pa.array([list(map(str, remaindered(row, moduli)))])], names=["i", "sums"])

    parts = vectors.select("x").mapInArrow(scatter, "i int, residues array<bigint>")
    rows = parts.repartition("i").mapInArrow(reduced, "i int, sums array<string>").collect()  # a row for each dimension
    whole = [list(map(int, r["sums"])) for r in sorted(rows)]
    return [r[dimension] for r in whole], [r[:dimension] for r in whole]


@dataclass(frozen=True)
class Whitening:
    """What a fit gives: the count n and the sums of the fitted vectors, eigenvalues and unit eigenvectors (columns) of their covariance."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def dimension(self) -> int:
        return len(self.sums)

    def scaled(self, components: int) -> np.ndarray:
        """Eigenvectors over the square roots of their eigenvalues; not a number where the eigenvalue is zero to double precision."""
        e = self.values[:components]
        least = self.values[:1].max(initial=0) * self.dimension * np.finfo(float).eps
        return self.vectors[:, :components] / np.sqrt(np.where(e > least, e, np.nan))

    def explained(self, components: int) -> list[float | None]:
        return [float(e / self.trace) if self.trace else None for e in self.values[:components]]

    def centre(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(y, r) with integers x - sums / n = y - r / n, where r is at most n / 2."""
        near = [(2 * s + self.n) // (2 * self.n) for s in self.sums]
        rest = [s - self.n * m for s, m in zip(self.sums, near, strict=True)]
        small = max(map(abs, near), default=0) < 1 << 61 and largest(x) < 1 << 61
        y = x - np.array(near, dtype=np.int64) if small else x.astype(object) - np.array(near, dtype=object)
        return y, np.array(rest, dtype=np.int64 if self.n < 1 << 62 else object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        y, r = self.centre(x)
        return y.astype(np.float64) - r.astype(np.float64) / self.n

    def deviations(self, x: np.ndarray) -> list[int]:
        """For each row, the sum over dimensions of (n x - sums)^2, exactly."""
        y, r = self.centre(x)
        most = largest(y)
        if (self.n * most + self.n) ** 2 * self.dimension > MOST:
            y, r = y.astype(object), r.astype(object)
        return ((y * self.n - r) ** 2).sum(axis=1).tolist()


def fit_whitening(vectors: DataFrame) -> Whitening | None:
    """The whitening of the distinct vectors ``x`` of a DataFrame that is read several times: write it first.  None without vectors.

    The dimension is the one that most distinct vectors have, the larger of two; vectors of another don't count.
    """
    size = F.size("x").alias("d")
    most = F.greatest(F.array_max("x").cast("decimal(20,0)"), -F.array_min("x").cast("decimal(20,0)"))
    counts = vectors.groupBy(size).agg(F.count("*").alias("n"), F.max(most).alias("most")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not counts:
        return None
    d, n, most = (int(x) for x in counts[0])
    sums, products = exact_scatter(vectors.where(F.size("x") == d), d, n * max(most, 1) ** 2)
    centred = [[n * products[i][j] - sums[i] * sums[j] for j in range(d)] for i in range(d)]
    # Integers that are divided as such are rounded once.
    covariance = np.array([[c / (n * n) for c in row] for row in centred])
    values, axes = np.linalg.eigh(covariance)
    trace = sum(centred[i][i] for i in range(d)) / (n * n)
    return Whitening(n, tuple(sums), np.maximum(values[::-1], 0), np.ascontiguousarray(axes[:, ::-1]), trace)


def identity_error(vectors: DataFrame, fit: Whitening, components: int = COMPONENTS) -> float | None:
    """The largest absolute entry of the covariance of the whitened vectors ``x`` less the identity.  None if no eigenvalue is above zero."""
    scale = fit.scaled(components)
    known = np.flatnonzero(~np.isnan(scale).any(axis=0))
    if not len(known):
        return None
    d, scale = fit.dimension, scale[:, known]
    k = len(known)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))
        for batch in slices(batches, SCORE_ROWS):
            if batch.num_rows:
                w = fit.centred(matrix(batch.column(0))) @ scale
                w = np.column_stack([w, np.ones(len(w))])
                total += w.T @ w
        yield pa.record_batch([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], names=["i", "v"])

    sums = vectors.where(F.size("x") == d).select("x").mapInArrow(moments, "i int, v double").groupBy("i").agg(F.sum("v")).collect()
    total = np.array([v for _, v in sorted(map(tuple, sums))]).reshape(k + 1, k + 1)
    mean = total[:k, k] / fit.n
    # Whitened vectors are centred but for rounding, so this subtraction loses nothing.
    return float(np.abs(total[:k, :k] / fit.n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(rows: DataFrame, fit: Whitening, key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """(key, component, whitened, deviation, deviation_wide) of rows with a vector ``x`` of the fit's dimension.

    Components count from 1, by falling eigenvalue, as many as there are dimensions at most; ``whitened`` is null where the eigenvalue is zero.  ``deviation``
    is null where it is beyond a long, ``deviation_wide`` where it is beyond 38 digits.
    """
    k = min(components, fit.dimension)
    scale = fit.scaled(k)
    kind = dict(rows.dtypes)[key]
    wide = pa.decimal128(38, 0)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SCORE_ROWS):
            if not batch.num_rows:
                continue
            x = matrix(batch.column(1))
            w = fit.centred(x) @ scale
            exact = np.repeat(np.array(fit.deviations(x), dtype=object), k).tolist()
            rows = np.repeat(np.arange(len(x)), k)
            yield pa.record_batch(
                [
                    batch.column(0).take(pa.array(rows)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(w.ravel(), mask=np.isnan(w.ravel())),
                    pa.array([v if v <= MOST else None for v in exact], pa.int64()),
                    pa.array([str(v) if v < 10**38 else None for v in exact], pa.string()).cast(wide),
                ],
                names=["tm_key", "component", "whitened", "deviation", "deviation_wide"],
            )

    found = rows.where(F.size("x") == fit.dimension).select(F.col(f"`{key}`").alias("tm_key"), "x")
    schema = f"tm_key {kind}, component int, whitened double, deviation bigint, deviation_wide decimal(38,0)"
    return found.mapInArrow(scored, schema).withColumnRenamed("tm_key", key)


def _by_component(values: list[float | None]) -> Column:
    return F.element_at(F.array(*(F.lit(v).cast("double") for v in values)), F.col("component"))


def whitened_embeddings(embeddings: DataFrame) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error, deviation_wide): four rows for each vector that counts.

    Nulls: rows whose vector is null, empty, or has null or non-finite entries have no rows, nor have those of
    another dimension than most distinct vectors; a null vec_id is a value like others.  Repeated rows are
    rows of their own, but fit once.  Without spread ``explained`` and ``whitened`` are null.  An empty table gives no rows.
    """
    rows = integer_vectors(embeddings.select("vec_id", "embedding")).select("vec_id", "x")
    distinct = cut(rows.select("x").distinct())
    fit = fit_whitening(distinct)
    if fit is None:
        none = "n bigint, deviation bigint, whitened double, explained double, identity_error double, deviation_wide decimal(38,0)"
        return embeddings.sparkSession.createDataFrame([], f"vec_id {dict(embeddings.dtypes)['vec_id']}, component int, {none}")
    error = identity_error(distinct, fit)
    return whiten(rows, fit).select(
        "vec_id",
        "component",
        F.lit(fit.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        _by_component(fit.explained(COMPONENTS)).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
        "deviation_wide",
    )
