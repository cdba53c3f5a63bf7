"""Whitening of embeddings, with an exact scatter matrix by residue numbers.

Entries become integers, and sums of products of integers are exact if no product or sum is rounded. Each partition
centres its rows exactly, takes them modulo several primes and multiplies the residues by float64 matrix products that
stay below 2**53, so they are exact. The residues are added over all partitions modulo each prime, and the driver
reconstructs the exact scatter from them by the Chinese remainder theorem. Only then does it become double, for eigh.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import discard, named, prepared, written

SCALE, OFFSET, MAX_COMPONENTS = 64, 1_000_000, 16
#: Primes are below 2**21, residues lie in (-p/2, p/2), and a block has 8,192 rows: sums of products stay below 2**53.
PRIME_BITS, BLOCK_ROWS = 21, 8192
#: An eigenvalue below this share of the greatest is rounding, and its component has no whitened values.
LEAST_SHARE = 1e-13
INT64 = 2**63 - 1


@dataclass(frozen=True)
class Whitening:
    """What the fit list gave: its n vectors, exact sums of each dimension, unit components as columns, and their eigenvalues."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float | None

    @property
    def dim(self) -> int:
        return len(self.sums)


def primes_below(limit: int, product_above: int) -> list[int]:
    """The greatest primes below limit, two at least, as many as it takes for their product to exceed product_above."""
    found: list[int] = []
    candidate = limit - 1
    while len(found) < 2 or prod(found) <= product_above:
        if all(candidate % d for d in range(2, int(candidate**0.5) + 1)):
            found.append(candidate)
        candidate -= 1
    return found


def integer_vector(vector: Column, scale: int, offset: int) -> Column:
    """floor(scale * entry) + offset of each entry, as array<bigint>; null where the vector or an entry is null, not finite, or beyond 2**52."""
    entries = vector.cast("array<double>")
    good = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * scale) < 2.0**52))
    return F.when(good & (F.size(entries) > 0), F.transform(entries, lambda c: F.floor(c * scale) + F.lit(offset).cast("long")))


def usable(vectors: DataFrame, vector: str, scale: int, offset: int, *own: Column) -> DataFrame:
    """own columns and x, the integer vector, of the rows whose vector can be used."""
    return vectors.select(*own, integer_vector(named(vector), scale, offset).alias("x")).where("x is not null")


def block(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of an array column of dim entries each as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def centred(x: np.ndarray, sums: tuple[int, ...], n: int) -> tuple[np.ndarray, np.ndarray]:
    """n * x - sums is n * whole - rest, exactly: whole = x - sums // n of each row, rest = sums % n."""
    whole, rest = np.array([s // n for s in sums], dtype=np.int64), np.array([s % n for s in sums], dtype=np.int64)
    return x - whole, rest


def moments(fit: DataFrame, dim: int) -> tuple[int, tuple[int, ...], int]:
    """Of the fit list: n, the exact sum of each dimension, and the widest range of one. Partitions add up halves of entries, so no sum overflows."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low, least, most = 0, np.zeros(dim, np.int64), np.zeros(dim, np.int64), None, None
        for batch in it:
            x = block(batch.column(0), dim)
            if len(x):
                n += len(x)
                high, low = high + (x >> 32).sum(0), low + (x & 0xFFFFFFFF).sum(0)
                least = x.min(0) if least is None else np.minimum(least, x.min(0))
                most = x.max(0) if most is None else np.maximum(most, x.max(0))
        if n:
            cells = (np.arange(dim), np.full(dim, n), high, low, least, most)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells], ["j", "n", "high", "low", "least", "most"])

    parts = fit.mapInArrow(batches, "j long, n long, high long, low long, least long, most long")
    whole = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "high", "low")]
    rows = sorted(parts.groupBy("j").agg(*whole, F.min("least").alias("least"), F.max("most").alias("most")).collect())
    if not rows:
        return 0, (), 0
    return int(rows[0].n), tuple(int(r.high) * 2**32 + int(r.low) for r in rows), max(r.most - r.least for r in rows)


def scatter(fit: DataFrame, n: int, sums: tuple[int, ...], widest: int) -> list[list[int]]:
    """The exact sum over the fit list of (n * x - sums) (n * x - sums)', by residues modulo several primes.

    An entry is at most n times (n * widest) squared, so that many bits of primes are used. What moves is a triangle of
    dim by dim residues a prime and partition, added up before the shuffle and in it.
    """
    dim = len(sums)
    bound = n * (n * max(widest, 1)) ** 2
    primes = primes_below(2**PRIME_BITS, 2 * bound)
    upper = np.triu_indices(dim)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((len(primes), dim, dim), np.int64)
        for batch in it:
            x = block(batch.column(0), dim)
            for at in range(0, len(x), BLOCK_ROWS):
                whole, rest = centred(x[at : at + BLOCK_ROWS], sums, n)
                for k, p in enumerate(primes):
                    residues = ((whole % p) * (n % p) - rest % p) % p
                    signed = np.where(residues > p // 2, residues - p, residues).astype(np.float64)
                    held[k] = (held[k] + (signed.T @ signed).astype(np.int64)) % p
        if held.any():
            i, j = upper
            cells = [np.repeat(np.arange(len(primes)), len(i)), np.tile(i, len(primes)), np.tile(j, len(primes)), held[:, i, j].ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells], ["k", "i", "j", "residue"])

    rows = fit.mapInArrow(batches, "k long, i long, j long, residue long").groupBy("k", "i", "j").agg(F.sum("residue").alias("residue")).collect()
    whole = prod(primes)
    lift = [whole // p * pow(whole // p, -1, p) for p in primes]  # 1 modulo its prime and 0 modulo the others
    out = [[0] * dim for _ in range(dim)]
    for r in rows:
        out[r.i][r.j] += lift[r.k] * (r.residue % primes[r.k])
    for i, j in zip(*upper, strict=True):
        value = out[i][j] % whole
        out[i][j] = out[j][i] = value - whole if value > whole // 2 else value
    return out


def projected(x: np.ndarray, model: Whitening) -> np.ndarray:
    """Whitened values of rows of integers; NaN for components without variance."""
    whole, rest = centred(x, model.sums, model.n)
    values = (whole - rest / model.n) @ model.components
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(model.eigenvalues > 0, values / np.sqrt(model.eigenvalues), np.nan)


def identity_error(fit: DataFrame, model: Whitening) -> float | None:
    """The largest absolute entry of the fit list's whitened covariance minus the identity, over components with variance; null if there is none."""
    keep = np.flatnonzero(model.eigenvalues > 0)
    if not len(keep):
        return None
    size = len(keep)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, products = np.zeros(size), np.zeros((size, size))
        for batch in it:
            w = projected(block(batch.column(0), model.dim), model)[:, keep]
            total, products = total + w.sum(0), products + w.T @ w
        cells = [np.repeat(np.arange(-1, size), size), np.tile(np.arange(size), size + 1), np.vstack([total, products]).ravel()]  # row -1 is the sum
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells], ["i", "j", "value"])

    rows = fit.mapInArrow(batches, "i long, j long, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect()
    found = np.zeros((size + 1, size))
    for r in rows:
        found[r.i + 1, r.j] = r.value / model.n
    return float(np.abs(found[1:] - np.outer(found[0], found[0]) - np.eye(size)).max())


def learn_whitening(vectors: DataFrame, vector: str = "embedding", scale: int = SCALE, offset: int = OFFSET, max_components: int = MAX_COMPONENTS) -> Whitening | None:
    """The whitening of all distinct integer vectors of a column; None if no row has a usable vector.

    A row counts if its vector and all entries are non-null and finite (and below 2**52 after scaling), and if it has the most frequent
    number of entries (the greater one on ties). Entries become floor(scale * entry) + offset; equal vectors count once, however often
    they repeat. Components of no variance have eigenvalue 0. The driver gets dim squared sums for each prime, whatever the number of rows.
    """
    spark = vectors.sparkSession
    prepared(spark)
    rows = usable(vectors, vector, scale, offset)
    sizes = rows.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    if not sizes:
        return None
    dim = sizes[0]["dim"]
    fit = written(rows.where(F.size("x") == dim).distinct(), "fit-list")
    n, sums, widest = moments(fit, dim)
    exact = scatter(fit, n, sums, widest)
    cube = n**3
    covariance = np.array([[v / cube for v in row] for row in exact])  # quotients of integers are rounded once
    values, vectors_ = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:max_components]
    values, axes = values[order], vectors_[:, order]
    axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(len(order))] < 0, -1.0, 1.0)
    values = np.where(values > max(values[0], 0.0) * LEAST_SHARE, values, 0.0)
    trace = float(Fraction(sum(exact[i][i] for i in range(dim)), cube))
    model = Whitening(n, sums, axes, values, trace, None)
    model = Whitening(n, sums, axes, values, trace, identity_error(fit, model))
    discard(fit)
    return model


def exact_deviations(x: np.ndarray, model: Whitening) -> list[int]:
    """For each row the sum over dimensions of (n * x - sums) squared, exactly."""
    whole, rest = centred(x, model.sums, model.n)
    largest = (int(np.abs(whole).max(initial=0)) + 1) * model.n
    if largest**2 * model.dim <= INT64:
        return ((whole * model.n - rest) ** 2).sum(1).tolist()
    return [sum((model.n * int(a) - int(r)) ** 2 for a, r in zip(row, rest, strict=True)) for row in whole]


def whiten(vectors: DataFrame, model: Whitening | None, vector: str = "embedding", key: str = "vec_id", scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """Each usable row's key, exact deviation (decimal, null beyond 38 digits) and whitened values, one for each component.

    Rows that learn_whitening passes over, and those of another number of entries than the model has, are left out; without a model the
    result is empty. Repeated rows and null keys stay, each for itself. A component without variance is null. Other columns are
    ignored, whatever their names. No shuffle; the model, of dim times components numbers, goes with the tasks.
    """
    prepared(vectors.sparkSession)
    rows = usable(vectors, vector, scale, offset, named(key).cast("long").alias("key"))
    schema = "key long, deviation decimal(38,0), whitened array<double>"
    if model is None:
        empty = [F.lit(None).cast("decimal(38,0)").alias("deviation"), F.lit(None).cast("array<double>").alias("whitened")]
        return rows.where("false").select(F.col("key").alias(key), *empty)
    width = model.components.shape[1]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        for batch in it:
            x = block(batch.column(1), model.dim)
            values = projected(x, model).ravel()
            flat = pa.array(values, mask=np.isnan(values))
            deviations = pa.array([Decimal(d) if d < 10**38 else None for d in exact_deviations(x, model)], pa.decimal128(38, 0))
            whitened = pa.ListArray.from_arrays(np.arange(0, width * len(x) + 1, width, dtype=np.int32), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), deviations, whitened], ["key", "deviation", "whitened"])

    return rows.where(F.size("x") == model.dim).mapInArrow(batches, schema).withColumnRenamed("key", key)
