"""Embedding whitening, with the covariance as exact integers from products of digit slices.

Vectors are turned into integers on a grid. Each distinct one counts once. A task subtracts an integer close to the mean of
each dimension, splits what is left into balanced digits of LIMB bits, and multiplies the slices of a batch by float64 BLAS:
a product of two slices and its sum over a batch stay far below 2**53, so they are exact. Sums by weight are small integers
that Spark adds up; the driver recombines them as big integers, takes the rest of the centring out exactly, divides once,
and decomposes the one matrix of d * d doubles. What reaches the driver grows with the square of d alone, not with the rows.

Defined results: vectors that are null, or hold null, NaN or infinite entries, take no part; of vectors of different
lengths those of the commonest length do (of equally common ones the shorter), empty ones never; entries beyond 2**61 on the
grid stay at that bound; a null vec_id is kept; repeated rows are returned each, though they count once in the fit; a
component without variance to double precision has a null `whitened` and no part in identity_error; a deviation beyond a
long is null; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lingora.llm.common import durable, partitions

LIMB = 12
EDGE = 2.0**61
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def finite(column: str):
    """Whether a vector is there and all its entries are finite numbers."""
    entries = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(F.col(column).isNotNull() & entries, F.lit(False))


def grid(vectors: DataFrame, scale: int, offset: int) -> DataFrame:
    """(vec_id, x): x is the vector floor(scale * c) + offset as 8-byte integers."""

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            lists = batch.column(1)
            entries = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            with np.errstate(over="ignore"):
                x = np.clip(np.floor(entries * scale), -EDGE, EDGE).astype("<i8") + offset
            ends = np.r_[0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]
            packed = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer((8 * ends).astype(np.int32)), pa.py_buffer(x)])
            yield pa.RecordBatch.from_arrays([batch.column(0), packed], ["vec_id", "x"])

    valid = vectors.where(finite("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return valid.mapInArrow(run, "vec_id long, x binary")


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, d)


def limbs(v: np.ndarray, bits: int = LIMB) -> list[np.ndarray]:
    """Digits of v in base 2**bits, from -2**(bits-1) on, the least first, as float64."""
    out, half = [], 1 << bits - 1
    while True:
        digit = ((v + half) & ((1 << bits) - 1)) - half
        out.append(digit.astype(np.float64))
        v = (v - digit) >> bits
        if not v.any():
            return out


def add_products(total: dict[int, np.ndarray], z: np.ndarray) -> None:
    """Adds the sums of products of all pairs of z's columns, by weight: their total is sum(total[w] << LIMB * w)."""
    slices = limbs(z)
    for a, left in enumerate(slices):
        for b, right in enumerate(slices):
            total[a + b] = total[a + b] + (left.T @ right).astype(np.int64)


def summed(df: DataFrame, make, kind: type) -> dict[int, np.ndarray]:
    """Sums by weight of the arrays that make(batches) returns of each task, as whole numbers or doubles.

    Tasks are dealt to as many lanes as the root of their number, and a lane's arrays are added in one task; so
    neither such a task nor the driver gets more than that many arrays of each weight.
    """
    lanes = max(1, round(partitions(df.sparkSession) ** 0.5))

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane = TaskContext.get().partitionId() % lanes
        for w, part in make(it).items():
            yield pa.RecordBatch.from_pydict({"lane": pa.array([lane], pa.int32()), "w": pa.array([w], pa.int32()), "s": pa.array([part.astype(kind).tobytes()])})

    def add(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(s.as_py(), kind) for s in rows.column("s"))
        return pa.table({"w": rows.column("w").slice(0, 1), "s": pa.array([total.tobytes()])})

    got = df.select("x").mapInArrow(run, "lane int, w int, s binary").groupBy("lane", "w").applyInArrow(add, "w int, s binary").collect()
    out: dict[int, np.ndarray] = {}
    for r in got:
        part = np.frombuffer(r.s, kind)
        out[r.w] = out.get(r.w, 0) + (part.astype(object) if kind is np.int64 else part)
    return out


def column_sums(fit: DataFrame, d: int) -> list[int]:
    """Exact sums of all dimensions."""

    def make(it: Iterable[pa.RecordBatch]) -> dict[int, np.ndarray]:
        total: dict[int, np.ndarray] = defaultdict(lambda: np.zeros(d, np.int64))
        for batch in it:
            for w, part in enumerate(limbs(matrix(batch.column(0), d))):
                total[w] += part.sum(0).astype(np.int64)
        return total

    return [int(v) for v in sum(s << LIMB * w for w, s in summed(fit, make, np.int64).items())]


def products(fit: DataFrame, d: int, pivot: list[int]) -> np.ndarray:
    """Exact sums of (x - pivot)(x - pivot)' over the list, as big integers."""
    at = np.array(pivot, np.int64)

    def make(it: Iterable[pa.RecordBatch]) -> dict[int, np.ndarray]:
        total: dict[int, np.ndarray] = defaultdict(lambda: np.zeros((d, d), np.int64))
        for batch in it:
            add_products(total, matrix(batch.column(0), d) - at)
        return total

    return sum(s << LIMB * w for w, s in summed(fit, make, np.int64).items()).reshape(d, d)


@dataclass
class Whitening:
    """The fit: n distinct vectors whose mean is pivot + rest / n, and the leading components."""

    n: int
    pivot: np.ndarray
    rest: list[int]
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float | None = None

    @property
    def d(self) -> int:
        return len(self.pivot)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """NaN for components without variance."""
        centred = (x - self.pivot).astype(np.float64) - np.array([r / self.n for r in self.rest])
        with np.errstate(divide="ignore"):
            return centred @ self.vectors * np.where(self.values > 0, 1 / np.sqrt(self.values), np.nan)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n * x - S)**2, exactly; None beyond a long."""
        z, rest = x - self.pivot, self.rest
        most = float(np.abs(z.astype(np.float64)).max(initial=0)) * self.n + self.n
        if self.d * most * most < 2.0**62:
            return ((self.n * z - np.array(rest, np.int64)) ** 2).sum(1).tolist()
        exact = [sum((self.n * a - r) ** 2 for a, r in zip(row, rest)) for row in z.tolist()]
        return [v if v < 2**63 else None for v in exact]


def decompose(n: int, sums: list[int], gram: np.ndarray, pivot: list[int], components: int) -> Whitening:
    """Components of the covariance gram / n - rest rest' / n**2, of which each entry is rounded once."""
    d, rest = len(sums), [s - n * k for s, k in zip(sums, pivot)]
    cov = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            cov[i, j] = cov[j, i] = (n * gram[i][j] - rest[i] * rest[j]) / n**2
    trace = sum(n * gram[i][i] - rest[i] ** 2 for i in range(d)) / n**2
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:components]
    values, vectors = values[order], vectors[:, order]
    values = np.where(values > d * np.finfo(float).eps * max(values[0], 0), values, 0.0)
    return Whitening(n, np.array(pivot, np.int64), rest, vectors, values, values / trace if trace > 0 else np.zeros(len(values)))


def fit_whitening(xs: DataFrame, components: int) -> tuple[Whitening | None, int]:
    """The fit over the distinct vectors of xs (x binary), and their length."""
    fit = durable(xs.select("x").where(F.length("x") > 0).distinct())
    lengths = fit.groupBy((F.length("x") / 8).cast("int").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not lengths:
        return None, 0
    d, n = lengths[0]["d"], lengths[0]["count"]
    fit = fit.where(F.length("x") == 8 * d)
    sums = column_sums(fit, d)
    pivot = [s // n for s in sums]
    model = decompose(n, sums, products(fit, d, pivot), pivot, components)
    k = len(model.values)

    def make(it: Iterable[pa.RecordBatch]) -> dict[int, np.ndarray]:
        total = np.zeros((k + 1, k))
        for batch in it:
            w = np.nan_to_num(model.whitened(matrix(batch.column(0), d)))
            total[:k] += w.T @ w
            total[k] += w.sum(0)
        return {0: total}

    found = summed(fit, make, np.float64)[0].reshape(k + 1, k) / n
    off = np.abs(found[:k] - np.outer(found[k], found[k]) - np.eye(k))[np.ix_(model.values > 0, model.values > 0)]
    model.identity_error = float(off.max()) if off.size else None
    return model, d


def whiten(vectors: DataFrame, components: int = 16, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """A row for each vector of (vec_id, embedding) and each component, numbered from 1 by falling variance."""
    rows = grid(vectors, scale, offset)
    model, d = fit_whitening(rows, components)
    if model is None:
        return vectors.sparkSession.createDataFrame([], RESULT)
    k = len(model.values)

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x = matrix(batch.column(1), d)
            take = pa.array(np.repeat(np.arange(len(x)), k))
            made = {
                "vec_id": batch.column(0).take(take),
                "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                "n": pa.array(np.full(len(take), model.n)),
                "deviation": pa.array(model.deviations(x), pa.int64()).take(take),
                "whitened": pa.array(model.whitened(x).ravel(), from_pandas=True),
                "explained": pa.array(np.tile(model.explained, len(x))),
                "identity_error": pa.array([model.identity_error], pa.float64()).take(pa.array(np.zeros(len(take), np.int64))),
            }
            yield pa.RecordBatch.from_pydict(made)

    return rows.where(F.length("x") == 8 * d).mapInArrow(run, RESULT)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
