"""Whitening of embeddings with a weighted covariance: each distinct vector is used once, its copies as a weight.

Rows are grouped by their integer vector x = floor(64 * c) + 1,000,000; a group's fit weight is its number of rows (or
one, ``weights="one"``, which fits on the distinct vectors). With n the weights' sum and S the weighted sums of x, tasks form
y = n * x - S in exact integers, centre as y / n, and add up weighted matrix products of blocks. The driver decomposes one
dims x dims matrix. Each distinct vector is whitened once. A group of one row carries its id along; only copies
are joined back, by a digest of x, with the largest groups broadcast, so one vector may make up any share of the rows.
The covariance of the whitened vectors is summed in the same way, centred block by block.

Rules for odd input: rows whose vector is null or holds null or non-finite entries are left out, and so are vectors of another
length than the most frequent one (ties: the longer). floor(64 * c) is limited to a magnitude of 2^52; a deviation
beyond a long is null. Components whose eigenvalue is under 1e-10 of the largest have no variance that doubles could tell from rounding, and are
left out; so a table of equal vectors, or an empty one, gives an empty result. Repeated and null ids are kept. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowstream.llm.centroids import LIMIT, SCALE, usable
from flowstream.llm.skew import join_counted
from flowstream.llm.text import quoted, stored

SHIFT = 1_000_000
ROWS = 4096  # vectors in a block
PARTS = 32  # partial matrices that reach the driver
LEAST = 1e-10  # smallest eigenvalue used, as a share of the largest

Moments = tuple[float, np.ndarray, np.ndarray]  # weight, mean, centred products


def _vectors(batch: pa.RecordBatch, column: str, dims: int) -> Iterator[tuple[slice, np.ndarray]]:
    for at in range(0, batch.num_rows, ROWS):
        part = batch.slice(at, ROWS)
        flat = part.column(part.schema.get_field_index(column)).flatten().to_numpy(zero_copy_only=False)
        yield slice(at, at + part.num_rows), flat.reshape(part.num_rows, dims)


def _wide(x: np.ndarray, n: int) -> bool:
    """Whether n * x or its squares' sum could leave 64 bits."""
    return bool(x.size) and 2 * n * int(np.abs(x).max()) >= 1 << 62


def _offsets(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: long where that is enough, Python's integers elsewhere."""
    if _wide(x, n) or max(map(abs, sums)) >= 1 << 62:
        return x.astype(object) * n - np.array(sums, dtype=object)
    return x * n - np.array(sums, dtype=np.int64)


def _deviations(y: np.ndarray) -> list[int | None]:
    if y.dtype != object and y.size and float(np.abs(y).max()) ** 2 * y.shape[1] < 2.0 ** 62:
        return (y * y).sum(axis=1).tolist()
    found = (y.astype(object) ** 2).sum(axis=1)
    return [int(v) if v < 1 << 63 else None for v in found]


def merged(a: Moments | None, b: Moments) -> Moments:
    """Moments of two sets together, each centred on its own mean."""
    if a is None:
        return b
    n = a[0] + b[0]
    apart = b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)


def moments(values: np.ndarray, weights: np.ndarray) -> Moments:
    n = weights.sum()
    mean = weights @ values / n
    centred = values - mean
    return n, mean, (centred * weights[:, None]).T @ centred


def _collected(rows: DataFrame, dims: int, blocks: Callable[[pa.RecordBatch], Iterator[Moments]]) -> Moments | None:
    """Moments of all blocks: summed per task, then in a few tasks, then on the driver, always in order of the tasks."""
    kind = "task int, w double, m array<double>, c array<double>"

    def row(task: int, total: Moments | None) -> pa.RecordBatch:
        some = [] if total is None else [total]
        return pa.record_batch([pa.array([task] * len(some), pa.int32()), pa.array([float(t[0]) for t in some], pa.float64()),
                                pa.array([t[1].tolist() for t in some], pa.list_(pa.float64())), pa.array([t[2].ravel().tolist() for t in some], pa.list_(pa.float64()))],
                               ["task", "w", "m", "c"])

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for block in blocks(batch):
                total = merged(total, block)
        yield row(TaskContext.get().partitionId(), total)

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = None, 0
        for batch in batches:
            for r in batch.to_pylist():
                first = first if total else r["task"]
                total = merged(total, (r["w"], np.array(r["m"]), np.array(r["c"]).reshape(dims, dims)))
        yield row(first, total)

    parts = rows.mapInArrow(one, kind).repartition(PARTS, F.col("task") % PARTS).sortWithinPartitions("task").mapInArrow(several, kind)
    total = None
    for r in sorted(parts.collect(), key=lambda r: r["task"]):
        total = merged(total, (r["w"], np.array(r["m"]), np.array(r["c"]).reshape(dims, dims)))
    return total


def distinct_vectors(kept: DataFrame, weights: str) -> DataFrame:
    """(_x, _rows, _weight, _one, _key) of each distinct vector; _one is the id of a vector's only row, _key joins copies back."""
    groups = kept.groupBy("_x").agg(F.count("*").alias("_rows"), F.min("_id").alias("_one"))
    weight = F.col("_rows") if weights == "counts" else F.lit(1).cast("long")
    return stored(groups.select("_x", "_rows", weight.alias("_weight"), "_one", F.when(F.col("_rows") > 1, _digest()).alias("_key")), "vectors")


def _digest():
    return F.unhex(F.sha2(F.array_join("_x", ",").cast("binary"), 256))


def weighted_sums(groups: DataFrame, dims: int) -> tuple[int, list[int]]:
    """n and S, exact."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dims
        for batch in batches:
            weights = batch.column(1).to_numpy()
            for part, x in _vectors(batch, "_x", dims):
                w = weights[part]
                n += int(w.sum())
                wide = x.size and int(np.abs(x).max()) * int(w.sum()) >= 1 << 62
                found = (x.astype(object) * w[:, None] if wide else x * w[:, None]).sum(axis=0)
                total = [a + int(b) for a, b in zip(total, found)]
        if n:
            yield pa.record_batch([pa.array(range(dims), pa.int32()), pa.array([str(t) for t in total]), pa.array([n] * dims, pa.int64())], ["d", "s", "n"])

    parts = groups.select("_x", "_weight").mapInArrow(sums, "d int, s string, n long")
    rows = parts.groupBy("d").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).orderBy("d").collect()
    return (rows[0].n, [int(r.s) for r in rows]) if rows else (0, [])


def whiten(vectors: DataFrame, *, components: int = 32, weights: str = "counts", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id, component, n, deviation, whitened, explained, identity_error of every usable vector and component."""
    if weights not in ("counts", "one"):
        raise ValueError("weights is 'counts' or 'one'")
    spark = vectors.sparkSession
    vector = quoted(vec_col)
    fine = vectors.select(quoted(id_col).alias("_id"), vector.alias("_v")).where(usable(vector))
    lengths = fine.groupBy(F.size("_v").alias("k")).count().orderBy(F.desc("count"), F.desc("k")).limit(1).collect()
    dims = lengths[0].k if lengths else 0
    whole = lambda c: F.greatest(F.least(F.floor(c.cast("double") * SCALE), F.lit(LIMIT)), F.lit(-LIMIT)).cast("long") + SHIFT
    kept = fine.where(F.size("_v") == dims).select("_id", F.transform("_v", whole).alias("_x"))
    id_type = kept.schema["_id"].dataType
    if dims:
        groups = distinct_vectors(kept, weights)
        n, sums = weighted_sums(groups, dims)
        basis, values, trace = _fit(groups, n, sums, dims, components)
    if not dims or not len(values):
        empty = spark.createDataFrame([], T.StructType([T.StructField(id_col, id_type)]))
        return empty.selectExpr("*", "0 as component", "0L as n", "0L as deviation", "0d as whitened", "0d as explained", "0d as identity_error")

    schema = T.StructType([T.StructField("_one", id_type), T.StructField("_key", T.BinaryType()), T.StructField("_rows", T.LongType()),
                           T.StructField("_weight", T.LongType()), T.StructField("_deviation", T.LongType()), T.StructField("_w", T.ArrayType(T.DoubleType()))])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x in _vectors(batch, "_x", dims):
                y = _offsets(x, n, sums)
                white = (y.astype(np.float64) / n) @ basis
                rows = batch.slice(part.start, len(x))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, white.size + 1, white.shape[1]), pa.int32()), pa.array(white.ravel()))
                yield pa.record_batch([rows.column(0), rows.column(1), rows.column(2), rows.column(3), pa.array(_deviations(y), pa.int64()), flat], schema.names)

    white = stored(groups.select("_one", "_key", "_rows", "_weight", "_x").mapInArrow(project, schema), "whitened")
    error = _identity_error(white, len(values))
    shares = F.array(*[F.lit(float(v / trace)) for v in values])

    def per_component(rows: DataFrame) -> DataFrame:
        return rows.select("_id", "_deviation", F.posexplode("_w").alias("_k", "whitened")).select(
            F.col("_id").alias(id_col), (F.col("_k") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), F.col("_deviation").alias("deviation"),
            "whitened", F.element_at(shares, F.col("_k") + 1).alias("explained"), F.lit(error).alias("identity_error"))

    single = white.where("_rows = 1").select(F.col("_one").alias("_id"), "_deviation", "_w")
    copies = white.where("_rows > 1").select("_key", "_rows", "_deviation", "_w")
    keyed = kept.select("_id", _digest().alias("_key"))
    back = join_counted(keyed, copies, ["_key"], "_rows", white.agg(F.sum("_rows")).first()[0]).select("_id", "_deviation", "_w")
    return per_component(single.unionByName(back))


def _fit(groups: DataFrame, n: int, sums: list[int], dims: int, components: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Columns that project a centred vector to unit variance, their eigenvalues in falling order, and the variances' sum."""
    def centred(batch: pa.RecordBatch) -> Iterator[Moments]:
        weights = batch.column(1).to_numpy().astype(np.float64)
        for part, x in _vectors(batch, "_x", dims):
            d = _offsets(x, n, sums).astype(np.float64) / n
            w = weights[part]
            yield w.sum(), np.zeros(dims), (d * w[:, None]).T @ d  # centred on the mean of all, so means are 0

    total = _collected(groups.select("_x", "_weight"), dims, centred)
    cov = total[2] / n
    values, axes = np.linalg.eigh((cov + cov.T) / 2)
    values, axes = values[::-1], axes[:, ::-1]
    used = int((values > LEAST * values[0]).sum()) if values[0] > 0 else 0
    used = min(used, components)
    return axes[:, :used] / np.sqrt(values[:used]), values[:used], float(np.trace(cov))


def _identity_error(white: DataFrame, k: int) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity."""
    def blocks(batch: pa.RecordBatch) -> Iterator[Moments]:
        weights = batch.column(1).to_numpy().astype(np.float64)
        for part, w in _vectors(batch, "_w", k):
            yield moments(w, weights[part])

    n, _, products = _collected(white.select("_w", "_weight"), k, blocks)
    return float(np.abs(products / n - np.eye(k)).max())
