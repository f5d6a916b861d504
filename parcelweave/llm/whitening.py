"""Whitening of embeddings from an exact scatter matrix.

Entries become integers, ``x = floor(scale * c) + shift``.  The fit list is each distinct ``x`` once.
The scatter of ``y = n * x - S`` (``S``: sums by dimension) is an integer matrix that may exceed 64
bits, so it is computed by residues: each partition multiplies ``y`` modulo several primes as
doubles, which are exact as long as sums stay under ``2 ** 53``, the residues are added up
across partitions, and the Chinese remainder theorem gives back the integers.  There are as many
primes as the greatest possible entry needs.  The covariance ``scatter / n ** 3`` is then rounded
once, and decomposed in double precision.

Only sums by dimension and matrices of dimension by dimension reach the driver.

Edge cases: rows whose vector is null or has null or non-finite entries are dropped, and so are
those whose length is not the commonest one (of equally common ones the longest); null and repeated
ids keep their rows; equal vectors count once in the fit; a component whose variance is zero to
double precision is not returned, so that one distinct vector alone, like an empty table, gives no
rows; entries whose ``x`` exceeds a long, and a deviation that does, are errors; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelweave.llm.common import take
from parcelweave.shipping import ship
from parcelweave.storage import discard, materialize

#: Residues are under 2 ** 20, and 8,192 of their products under 2 ** 53.
PRIME_BITS, BLOCK = 20, 8192


def primes(bound: int) -> list[int]:
    """The largest primes of ``PRIME_BITS`` bits whose product exceeds ``bound``."""
    found, x = [], (1 << PRIME_BITS) - 1
    while prod(found) <= bound:
        if all(x % q for q in range(3, int(x**0.5) + 1, 2)):
            found.append(x)
        x -= 2
    return found


def reconstructed(residues: np.ndarray, moduli: list[int]) -> np.ndarray:
    """The integers of least absolute value with these residues; ``residues`` has a first axis for the moduli."""
    whole = prod(moduli)
    total = sum(residues[k].astype(object) % p * (whole // p * pow(whole // p, -1, p)) for k, p in enumerate(moduli)) % whole
    return np.where(total > whole // 2, total - whole, total)


def _matrix(column) -> np.ndarray:
    """Arrow lists of equal length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _added(parts: DataFrame, kind: str) -> DataFrame:
    """``(k, i, v)``: lists added up by ``k`` and ``i``; a task holds one list for each of its keys."""
    dtype = np.int64 if kind == "long" else np.float64

    def run(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                for k, i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _matrix(batch.column(2)), strict=True):
                    sums[k, i] = sums[k, i] + v if (k, i) in sums else v.astype(dtype)
        yield _rows(sums, dtype)

    return parts.repartition("k", "i").mapInArrow(run, f"k int, i int, v array<{kind}>")


def _rows(sums: dict[tuple[int, int], np.ndarray], dtype) -> pa.RecordBatch:
    keys, lists = list(sums), list(sums.values())
    ends = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
    flat = np.concatenate([np.zeros(0, dtype), *lists]).astype(dtype)
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.int32()), pa.array([i for _, i in keys], pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["k", "i", "v"])


def whole_vectors(vectors: DataFrame, id_col: str, vec_col: str, scale: int, shift: int) -> DataFrame:
    """``(id, x)`` of the rows that stay."""
    rows = take(vectors, id=id_col, vec=vec_col).withColumn("vec", F.col("vec").cast("array<double>"))
    inf = float("inf")
    rows = rows.where(F.col("vec").isNotNull() & F.forall("vec", lambda c: F.coalesce(~F.isnan(c) & (c < inf) & (c > -inf), F.lit(False))))
    lengths = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = lengths["d"] if lengths else 0
    return rows.where(F.size("vec") == d).select("id", F.transform("vec", lambda c: F.floor(c * scale) + F.lit(shift).cast("long")).alias("x"))


def _sums(fit: DataFrame) -> tuple[int, list[int], list[int], list[int]]:
    """Number of vectors; sums, least and greatest values by dimension."""

    def run(batches):
        n, s, lo, hi = 0, None, None, None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                n += len(x)
                s = x.sum(axis=0) if s is None else s + x.sum(axis=0)
                lo = x.min(axis=0) if lo is None else np.minimum(lo, x.min(axis=0))
                hi = x.max(axis=0) if hi is None else np.maximum(hi, x.max(axis=0))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(s), dtype=np.int32)), pa.array(np.full(len(s), n, np.int64)), pa.array(s), pa.array(lo), pa.array(hi)], names=["i", "n", "s", "lo", "hi"])

    wide = fit.select("x").mapInArrow(run, "i int, n long, s long, lo long, hi long").groupBy("i").agg(F.sum("n"), F.sum(F.col("s").cast("decimal(38,0)")), F.min("lo"), F.max("hi"))
    found = sorted(wide.collect())  # a row for each dimension
    return found[0][1] if found else 0, [int(r[2]) for r in found], [r[3] for r in found], [r[4] for r in found]


def scatter(fit: DataFrame, n: int, sums: list[int], most: int) -> np.ndarray:
    """The exact sums of products of ``n * x - sums``, none of whose entries exceeds ``most``, over ``fit``."""
    moduli = primes(2 * n * most * most + 1)
    d = len(sums)

    def run(batches):
        total = np.zeros((len(moduli), d, d), np.int64)
        for batch in batches:
            x = _matrix(batch.column(0)) if batch.num_rows else np.zeros((0, d), np.int64)
            for at in range(0, len(x), BLOCK):
                for k, p in enumerate(moduli):
                    y = ((n % p) * (x[at : at + BLOCK] % p) - np.array([s % p for s in sums])) % p
                    y = y.astype(np.float64)
                    total[k] = (total[k] + (y.T @ y).astype(np.int64)) % p
        yield _rows({(k, i): total[k, i] for k in range(len(moduli)) for i in range(d)}, np.int64)

    ship(fit.sparkSession)
    found = np.zeros((len(moduli), d, d), object)
    for k, i, v in _added(fit.select("x").mapInArrow(run, "k int, i int, v array<long>"), "long").collect():
        found[k, i] = v
    return reconstructed(found, moduli)


class Whitener:
    """Components of the fit list's covariance, and the exact terms to project on them."""

    def __init__(self, n: int, sums: list[int], exact: np.ndarray, most: int, keep: int):
        self.n, self.most = n, most
        covariance = (exact / n**3).astype(np.float64)
        trace = int(np.trace(exact)) / n**3
        values, vectors = np.linalg.eigh(covariance)
        order = [k for k in range(len(values) - 1, -1, -1) if values[k] > len(values) * np.finfo(float).eps * max(values[-1], 0)][:keep]
        self.whole, self.part = np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64)
        self.project = vectors[:, order] / np.sqrt(values[order])
        self.explained = values[order] / trace if trace else values[order]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.whole).astype(np.float64) - self.part / self.n) @ self.project

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """The sum over dimensions of ``(n * x - sums) ** 2``."""
        far = x - self.whole
        if x.shape[1] * self.most * self.most < 1 << 63:
            return ((self.n * far - self.part) ** 2).sum(axis=1)
        exact = ((self.n * far.astype(object) - self.part.astype(object)) ** 2).sum(axis=1)
        return np.array([int(v) for v in exact], np.int64)


def _identity_error(fit: DataFrame, model: Whitener) -> float:
    """The largest entry of the difference between the whitened fit list's covariance and the identity."""
    m = model.project.shape[1]

    def run(batches):
        n, mean, spread = 0, np.zeros(m), np.zeros((m, m))
        for batch in batches:
            if batch.num_rows:
                w = model.whitened(_matrix(batch.column(0)))
                own = w.mean(axis=0)
                spread += (w - own).T @ (w - own) + np.outer(own - mean, own - mean) * (n * len(w) / (n + len(w)))
                mean, n = mean + (own - mean) * (len(w) / (n + len(w))), n + len(w)
        yield _rows({(0, i): np.concatenate((spread[i] + n * mean[i] * mean, [n * mean[i]])) for i in range(m)}, np.float64)

    total = np.zeros((m, m + 1))
    for _, i, v in _added(fit.select("x").mapInArrow(run, "k int, i int, v array<double>"), "double").collect():
        total[i] = v
    mean = total[:, m] / model.n
    return float(np.abs(total[:, :m] / model.n - np.outer(mean, mean) - np.eye(m)).max(initial=0.0))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", keep: int = 16, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """``(id_col, component, n, deviation, whitened, explained, identity_error)``: a row for each vector and component."""
    spark = vectors.sparkSession
    ship(spark)
    rows = whole_vectors(vectors, id_col, vec_col, scale, shift)
    fit = materialize(rows.select("x").distinct(), "fit")
    n, sums, lo, hi = _sums(fit)
    schema = T.StructType([T.StructField(id_col, rows.schema["id"].dataType), *T.StructType.fromDDL("component int, n long, deviation long, whitened double, explained double, identity_error double").fields])
    if not sums:
        discard(fit)
        return spark.createDataFrame([], schema)
    most = max(max(n * b - s, s - n * a) for s, a, b in zip(sums, lo, hi, strict=True))
    model = Whitener(n, sums, scatter(fit, n, sums, most), most, keep)
    error, m = _identity_error(fit, model), model.project.shape[1]
    discard(fit)

    def run(batches):
        for batch in batches:
            if batch.num_rows and m:
                x = _matrix(batch.column(1))
                ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(x)), m)))
                columns = [np.tile(np.arange(1, m + 1, dtype=np.int32), len(x)), np.full(len(x) * m, n), np.repeat(model.deviation(x), m), model.whitened(x).ravel(), np.tile(model.explained, len(x)), np.full(len(x) * m, error)]
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, columns)], names=schema.names)

    return rows.mapInArrow(run, schema)
