"""Embedding whitening from exact integer scatter.

Entries become integers x = floor(scale * c) + offset. A shift, one row of the table, is subtracted, and sums and cross-products are
accumulated without rounding: in a task by matrix products of limbs so small that every partial sum of the float product is a
whole number below 2**53, then as Python integers of any size; between tasks as limbs of 2**40 that Spark adds up as
decimals. From their totals n·XᵀX − SSᵀ is formed in integers, which no shift changes, and only then divided, turned to
floating point and decomposed by eigh. The driver holds one number for each pair of dimensions, whatever the number of rows.

Defined cases: rows whose vector is null or holds null or non-finite entries are dropped; so are vectors that haven't the
length most vectors have (of lengths as frequent, the greatest), empty ones always, as they have no place in the matrix; numbers beyond 64 bits
end at its bounds; repeated rows count each; null ids stay null; components whose eigenvalue isn't above the rounding
error of the largest are left out, as they can't be scaled to one, so a table without variance has no rows; a deviation that
doesn't fit a long is a decimal in `whitened` and null in the query; no rows give no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlake.llm.common import settle

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
#: Bits of a limb of a total that goes between tasks; rows of a matrix product; float integers are exact up to 2**EXACT.
LIMB, CHUNK, EXACT = 40, 8_192, 53
_LONG = 2**63


def usable(vector: Column) -> Column:
    """Whether a vector has no null and no non-finite entry."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, bad)


def integers(rows: np.ndarray, scale: int = SCALE, offset: int = OFFSET) -> np.ndarray:
    """floor(scale * c) + offset as longs, at their bounds where they don't fit."""
    x = np.floor(rows.astype(np.float64) * scale)
    top = np.nextafter(float(_LONG), 0)  # the greatest double below 2**63
    whole = np.clip(x, -float(_LONG), top).astype(np.int64)
    room = whole > _LONG - 1 - offset
    return np.where(room | (x > top), _LONG - 1, np.where(room, 0, whole) + offset)


def _limbs(y: np.ndarray, bits: int) -> list[np.ndarray]:
    """Signed parts of so many bits, lowest first, whose shifted sum is y."""
    parts = []
    while y.any():
        low = ((y + (1 << (bits - 1))) & ((1 << bits) - 1)) - (1 << (bits - 1))
        parts.append(low)
        y = (y - low) >> bits
    return parts


def exact_gram(y: np.ndarray) -> np.ndarray:
    """YᵀY of an integer matrix of Python integers or longs, as Python integers; no product is rounded."""
    d, bits = y.shape[1], (EXACT - max(1, len(y)).bit_length()) // 2 - 1
    parts = [p.astype(np.float64) for p in _limbs(y, bits)]
    total = np.zeros((d, d), dtype=object)
    for i, a in enumerate(parts):
        for j, b in enumerate(parts):
            total += (a.T @ b).astype(np.int64).astype(object) * (1 << (bits * (i + j)))
    return total


def _shifted(x: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """x - shift; longs where the difference fits, else Python integers."""
    if max(np.abs(x.astype(np.float64)).max(initial=0), np.abs(shift.astype(np.float64)).max(initial=0)) < 2**61:
        return x - shift
    return x.astype(object) - shift.astype(object)


def _split(value: int) -> list[int]:
    """Signed limbs of a total, lowest first."""
    out, sign, value = [], -1 if value < 0 else 1, abs(int(value))
    while value:
        out.append(sign * (value & ((1 << LIMB) - 1)))
        value >>= LIMB
    return out


def _matrices(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of vectors of one length, a bounded number of rows at a time, with their matrix."""
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            part = batch.slice(at, CHUNK)
            yield part, part.column(column).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)


@dataclass(frozen=True)
class Whitening:
    """n rows, sums of y = x - shift, eigenvalues (falling) with their eigenvectors as columns, trace of the covariance."""

    n: int
    shift: np.ndarray
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def deviations(self, rows: np.ndarray) -> np.ndarray:
        """n * x - S for each row and dimension, exactly."""
        y = _shifted(integers(rows), self.shift)
        if y.dtype != object and self.n * (int(np.abs(y).max(initial=0)) + 1) + max(map(abs, self.sums), default=0) < _LONG:
            return self.n * y - np.array(self.sums, dtype=np.int64)
        return self.n * y.astype(object) - np.array(self.sums, dtype=object)

    def project(self, deviations: np.ndarray) -> np.ndarray:
        """Whitened components of rows: x - S / n on each eigenvector, over the root of its eigenvalue."""
        centred = (deviations / self.n).astype(np.float64)  # of whole numbers: rounded once
        return centred @ self.vectors / np.sqrt(self.values)


def decompose(n: int, sums: list[int], products: np.ndarray, shift: np.ndarray, most: int = COMPONENTS) -> Whitening:
    """From exact totals: the scatter in integers, then its quotient by n² in floating point, then eigh."""
    s = np.array(sums, dtype=object)
    scatter = n * products - np.outer(s, s)
    v = np.array([[int(c) / (n * n) for c in row] for row in scatter], dtype=np.float64)  # int / int is rounded once
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(v))] < 0, -1.0, 1.0)
    kept = int((values > len(v) * np.finfo(float).eps * max(values.max(initial=0), 0)).sum())
    kept = min(kept, most)
    return Whitening(n, shift, [int(x) for x in sums], values[:kept].copy(), vectors[:, :kept].copy(), float(np.trace(v)))


def vectors_of(rows: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(id, vector) of the usable rows of the most frequent length, and that length; 0 where there is none."""
    named = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).where(usable(F.col("vector")))
    lengths = named.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    d = lengths[0].d if lengths else 0
    return named.where(F.size("vector") == d).select("id", F.col("vector").cast("array<double>").alias("vector")), d


def totals(vectors: DataFrame, d: int, shift: np.ndarray) -> tuple[int, list[int], np.ndarray]:
    """n, sums and cross-products of x - shift over all vectors, as Python integers."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(d, dtype=object), np.zeros((d, d), dtype=object)
        for part, rows in _matrices(batches):
            y = _shifted(integers(rows), shift)
            n += part.num_rows
            sums += y.astype(object).sum(axis=0)
            products += exact_gram(y)
        if not n:
            return
        cells = [(-1, -1, n), *((-1, k, sums[k]) for k in range(d)), *((j, k, products[j, k]) for j in range(d) for k in range(j, d))]
        flat = [(j, k, i, limb) for j, k, value in cells for i, limb in enumerate(_split(value))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*flat), (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["j", "k", "limb", "value"])

    parts = vectors.select("vector").mapInArrow(add, "j int, k int, limb int, value long")
    n, sums, products = 0, [0] * d, np.zeros((d, d), dtype=object)
    for j, k, limb, value in parts.groupBy("j", "k", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect():
        whole = int(value) << (LIMB * limb)
        if k < 0:
            n += whole
        elif j < 0:
            sums[k] += whole
        else:
            products[j, k] += whole
            products[k, j] = products[j, k]
    return n, sums, products


def fit(vectors: DataFrame, d: int, components: int = COMPONENTS) -> Whitening | None:
    first = vectors.limit(1).collect() if d else []
    if not first:
        return None
    shift = integers(np.array([first[0].vector]))[0]
    return decompose(*totals(vectors, d, shift), shift, components)


def identity_error(vectors: DataFrame, white: Whitening) -> float:
    """Largest entry of the whitened rows' covariance minus the identity: rows are centred, multiplied and summed by task, then added up."""
    k = len(white.values)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for _, rows in _matrices(batches):
            z = white.project(white.deviations(rows))
            total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(k), k), pa.int32()), pa.array(np.tile(np.arange(k), k), pa.int32()), pa.array(total.ravel())], names=["i", "j", "value"])

    summed = vectors.select("vector").mapInArrow(add, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))
    off = F.abs(F.col("value") / white.n - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0))
    return float(summed.agg(F.max(off)).first()[0])


def whitened(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: id, component, n, deviation (decimal), whitened, explained, identity_error."""
    kind = dict(rows.select(F.col(id_col).alias("id")).dtypes)["id"]
    schema = f"id {kind}, deviation decimal(38,0), parts array<double>"
    vectors, d = vectors_of(rows, id_col, vector_col)
    vectors = settle(vectors, "vectors")
    white = fit(vectors, d, components)
    if white is None or not len(white.values):
        empty = f"{id_col} {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
        return rows.sparkSession.createDataFrame([], empty)
    error = identity_error(vectors, white)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, entries in _matrices(batches, 1):
            off = white.deviations(entries)
            small = off.dtype != object and int(np.abs(off).max(initial=0)) ** 2 * max(1, d) < _LONG
            far = (off * off).sum(axis=1) if small else (off.astype(object) ** 2).sum(axis=1)
            z = white.project(off)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * z.shape[1], pa.int32()), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_decimals(far), pa.decimal128(38, 0)), lists], names=["id", "deviation", "parts"])

    explained = F.get(F.lit([float(e / white.trace) for e in white.values]), F.col("component"))
    each = vectors.mapInArrow(scan, schema).select("id", "deviation", F.posexplode("parts").alias("component", "whitened"))
    return each.select(
        F.col("id").alias(id_col),
        (F.col("component") + 1).cast("int").alias("component"),
        F.lit(white.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        explained.alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def _decimals(values: np.ndarray) -> list:
    """Whole numbers as decimals; null beyond 38 digits."""
    from decimal import Decimal

    return [Decimal(int(v)) if v < 10**38 else None for v in values]


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))


QUERIES = {"op13_whitening": op13_whitening}
#: No eigenvectors in SQL; the tests hold the query against rational arithmetic.
SQL: dict[str, str] = {}
