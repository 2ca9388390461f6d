"""Whiten embedding vectors: uncorrelated components of variance one, in the order of their variance.

Vectors are taken on a grid of whole numbers, x = floor(1024 * c) + 100000, so that equal ones are found exactly and sums are exact.
Equal x are one row with a count; sums, the covariance and the projection see each of them once, weighted by its count (or by one).
The covariance is a sum of products of centred matrices, one for each task, that Spark adds up; only it and what has the size of a vector come
to the driver. What is found for a distinct vector is joined back to the rows that have it.

Rows whose vector is null or has null or non-finite entries are dropped, and so are those of another length than most have (of
equally frequent lengths the longest counts): they have no place in one covariance. Null and repeated ids are kept, a row each. Entries beyond +-2**62 count as that.
A component whose variance is nought but for rounding (constant or dependent dimensions, fewer than two distinct vectors) can't be scaled and is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_back, materialize

SCALE, SHIFT, FAR = 1024.0, 100_000, 1 << 62
#: Values of a task's block of vectors that are worked on at once.
BLOCK_VALUES = 1 << 20


def grid(vector: Column) -> Column:
    """The whole numbers that stand for a vector's entries."""
    return F.transform(vector, lambda c: F.least(F.greatest(F.floor(F.lit(SCALE) * c.cast("double")), F.lit(-FAR)), F.lit(FAR)) + F.lit(SHIFT))


def usable(vector: Column) -> Column:
    """Whether a vector has finite entries only. False for null."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


@dataclass(frozen=True)
class Whitening:
    """``n`` vectors of sums ``sums`` were fitted; ``axes`` has a unit eigenvector in each column, ``variances`` their eigenvalues, both of the covariance of trace ``trace``."""

    n: int
    sums: tuple[int, ...]
    variances: np.ndarray
    axes: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n of rows of whole numbers. The division comes last, on exact numbers, where these fit a long."""
        return _spread(x, self.n, self.sums).astype(np.float64) / self.n


def _spread(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n * x - S exactly: as longs where they fit, else as Python's integers."""
    most = n * int(np.abs(x.astype(np.float64)).max(initial=0)) + max(map(abs, sums), default=0)
    if most < FAR:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _squares(spread: np.ndarray) -> list[int | None]:
    """Sums of squares of each row, exact; none where they don't fit a long."""
    most = float(np.abs(spread.astype(np.float64)).max(initial=0))
    if most * most * max(spread.shape[1], 1) < FAR:
        return np.einsum("ij,ij->i", spread, spread).tolist()
    exact = [sum(int(v) ** 2 for v in row) for row in spread]
    return [v if v < 1 << 63 else None for v in exact]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, weights, matrix of x) of some BLOCK_VALUES values each."""
    for batch in batches:
        width = len(batch.column("x")[0]) if batch.num_rows else 0
        step = max(1, BLOCK_VALUES // max(1, width))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield part, part.column("weight").to_numpy(), part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, width)


def _exact_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: list[int] = []
    for _, weight, x in _blocks(batches):
        fits = float(np.abs(x.astype(np.float64)).max(initial=0)) * float(weight.sum()) < FAR
        sums = (weight @ x if fits else weight.astype(object) @ x.astype(object)).tolist()
        total = [a + b for a, b in zip(total, sums, strict=True)] if total else sums
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(map(Decimal, map(int, total)), pa.decimal128(38, 0))], ["i", "s"])


def _summed(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], kind: str) -> list:
    """Values s by place i, added over the tasks by Spark; one for each place comes to the driver."""
    found = rows.mapInArrow(run, f"i int, s {kind}").groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()
    return [r["s"] for r in found]


def _products(centre: Callable[[np.ndarray], np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums over a task's rows of weight * y y', where y = centre(x): one matrix product a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, weight, x in _blocks(batches):
            y = centre(x)
            product = (y * weight[:, None]).T @ y
            total = product if total is None else total + product
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], ["i", "s"])

    return run


def _weighted_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for _, weight, x in _blocks(batches):
        sums = weight @ x
        total = sums if total is None else total + sums
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["i", "s"])


def distinct_vectors(rows: DataFrame, weights: str = "counts") -> DataFrame:
    """(x, copies, weight) of each distinct x of the most frequent length. Copies are counted before the shuffle, so a vector that many rows have is no burden."""
    if weights not in ("counts", "one"):
        raise ValueError("weights are counts or one")
    found = rows.groupBy("x").agg(F.count(F.lit(1)).alias("copies"))
    found = materialize(found.withColumn("weight", F.col("copies") if weights == "counts" else F.lit(1).cast("long")), "vectors")
    width = found.groupBy(F.size("x").alias("width")).agg(F.sum("copies").alias("rows")).orderBy(F.desc("rows"), F.desc("width")).first()
    return found.filter(F.size("x") == (width["width"] if width else 0))


def fit(vectors: DataFrame, components: int = 8) -> Whitening:
    """The whitening of distinct vectors (x, weight)."""
    n = vectors.agg(F.sum("weight")).first()[0] or 0
    sums = tuple(int(s) for s in _summed(vectors, _exact_sums, "decimal(38,0)"))
    d = len(sums)
    if not d:
        return Whitening(int(n), (), np.zeros(0), np.zeros((0, 0)), 0.0)
    bare = Whitening(int(n), sums, np.zeros(0), np.zeros((d, 0)), 0.0)
    covariance = np.array(_summed(vectors, _products(bare.centred), "double")).reshape(d, d) / n
    covariance = (covariance + covariance.T) / 2
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes[:, ::-1]
    real = int(np.count_nonzero(values > max(values[0], 0) * d * np.finfo(float).eps * 8))
    k = min(components, real)
    return Whitening(int(n), sums, values[:k].copy(), axes[:, :k].copy(), float(np.trace(covariance)))


def apply(vectors: DataFrame, model: Whitening) -> DataFrame:
    """The distinct vectors with deviation and whitened (an array, a value for each component), written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale = np.sqrt(model.variances)
        for part, weight, x in _blocks(batches):
            white = model.centred(x) @ model.axes / scale
            flat = pa.array(white.ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(white) + 1) * white.shape[1], pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([part.column("digest"), part.column("copies"), pa.array(weight), pa.array(_squares(_spread(x, model.n, model.sums)), pa.int64()), lists], ["digest", "copies", "weight", "deviation", "x"])

    whitened = vectors.select(vector_digest(F.col("x")).alias("digest"), "copies", "weight", "x").mapInArrow(run, "digest string, copies long, weight long, deviation long, x array<double>")
    return materialize(whitened, "whitened").withColumnRenamed("x", "whitened")


def identity_error(whitened: DataFrame, n: int) -> float:
    """Largest entry of the covariance of what was whitened, less the identity."""
    rows = whitened.select(F.col("whitened").alias("x"), "weight")
    mean = np.array(_summed(rows, _weighted_sums, "double")) / max(n, 1)
    k = len(mean)
    if not k:
        return 0.0
    covariance = np.array(_summed(rows, _products(lambda x: x - mean), "double")).reshape(k, k) / n
    return float(np.abs(covariance - np.eye(k)).max())


def vector_digest(x: Column) -> Column:
    """Stands for a distinct vector in joins, an eighth of its size or less."""
    return F.sha2(F.array_join(x, ",").cast("binary"), 256)


def whiten(rows: DataFrame, components: int = 8, weights: str = "counts", id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, Whitening, float]:
    """(id, n, deviation, whitened: array of at most ``components`` values) of each row that is kept, the fitted whitening, and its identity error."""
    own = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    kept = own.filter(usable(F.col("vector"))).select("id", grid(F.col("vector")).alias("x"))
    vectors = distinct_vectors(kept, weights)
    model = fit(vectors, components)
    whitened = apply(vectors, model)
    error = identity_error(whitened, model.n) if len(model.variances) else 0.0
    keyed = materialize(kept.select("id", vector_digest(F.col("x")).alias("digest")), "keyed")
    found = join_back(keyed, whitened.select("digest", "copies", "deviation", "whitened"), "digest", "copies")
    return found.select("id", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened"), model, error


def components_of(found: DataFrame, model: Whitening, error: float, id_col: str = "vec_id") -> DataFrame:
    """One row for each vector and component."""
    share = F.array(*(F.lit(float(v) / model.trace) for v in model.variances)).cast("array<double>")
    flat = found.select("id", "n", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return flat.select(F.col("id").alias(id_col), (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", F.get(share, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
