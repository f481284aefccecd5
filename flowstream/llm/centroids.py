"""Centroid clustering of vectors in exact integers, with Orchard's search for the nearest centroid.

For each centroid the others are listed by their distance to it. A vector starts at one centroid and walks its list; at
the first centroid that is closer it jumps to that one's list. It stops at a list entry that lies strictly beyond twice
its distance, as no later one can be nearer. Centroids already tried are marked and skipped. Many vectors walk in lockstep,
as arrays. Twice the distance is four times the squared one, so integers decide all comparisons, and the results don't depend on partitions.

A round sends one partial sum per task, centroid and dimension to the shuffle; the driver holds only the centroids. No vector is moved,
so repeated vectors and hot keys need no care.

Rules for odd input: vectors that are null, hold null or non-finite entries, or have another length than ``dims`` are
left out. A component is floor(64 * x), in magnitude at most 2^52; squared distances and sums beyond a long are null.
Equal hashes of the start (repeated ids) go by the smaller vector; a null id counts as empty text. With fewer vectors than ``k``, each one is a
centroid. Equal centroids: the smaller number wins. An empty table gives an empty result. Other columns are left out, and their names don't matter.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowstream.llm.text import quoted, stored

SCALE = 64
LIMIT = 1 << 52  # largest component
SAFE = 1 << 26  # components up to this one have squared distances that fit a long, for up to 128 dimensions
ROWS = 4096  # vectors that walk together


def usable(vector: Column, dims: int | None = None) -> Column:
    """Whether a vector has only finite entries (and, if given, this length)."""
    infinite = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    fine = vector.isNotNull() & ~F.exists(vector, infinite)
    return fine & (F.size(vector) == dims) if dims is not None else fine


def _integers(values: np.ndarray) -> np.ndarray:
    """floor(64 * x) in a type whose squares and sums are exact: long, or Python's integers for wide values."""
    whole = np.clip(np.floor(values.astype(np.float64) * SCALE), -LIMIT, LIMIT).astype(np.int64)
    return whole if not whole.size or np.abs(whole).max() <= SAFE else whole.astype(object)


def _exact(rows: Sequence[Sequence[int]]) -> np.ndarray:
    wide = any(abs(v) > SAFE for row in rows for v in row)
    return np.array(rows, dtype=object if wide else np.int64).reshape(len(rows), -1)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if a.dtype == object or b.dtype == object:
        a, b = a.astype(object), b.astype(object)
    return ((a - b) ** 2).sum(axis=1)


class Orchard:
    """Nearest of a few centroids, ties to the smaller number."""

    def __init__(self, centroids: Sequence[Sequence[int]]):
        self.centroids = _exact(centroids)
        k = len(self.centroids)
        self.gaps = np.array([_squared(self.centroids, self.centroids[i:i + 1]) for i in range(k)])
        # neighbours of each centroid, nearest first, itself left out
        self.order = np.array([[j for j in sorted(range(k), key=lambda j: (self.gaps[i][j], j)) if j != i] for i in range(k)], dtype=np.int64).reshape(k, k - 1)
        self.compared = 0

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of the nearest centroid of each row of integers."""
        n, k = len(x), len(self.centroids)
        found, place = np.zeros(n, np.int64), np.zeros(n, np.int64)
        tried = np.zeros((n, k), bool)
        tried[:, 0] = True
        least = _squared(x, self.centroids[:1])
        walking = np.arange(n) if k > 1 else np.zeros(0, np.int64)
        self.compared += n
        while len(walking):
            at = found[walking]
            other = self.order[at, place[walking]]
            goes_on = ~(self.gaps[at, other] > 4 * least[walking]).astype(bool)
            walking, other = walking[goes_on], other[goes_on]
            place[walking] += 1
            new = ~tried[walking, other]
            rows, other = walking[new], other[new]
            tried[rows, other] = True
            self.compared += len(rows)
            distance = _squared(x[rows], self.centroids[other])
            closer = ((distance < least[rows]) | (distance == least[rows]) & (other < found[rows])).astype(bool)
            rows, other = rows[closer], other[closer]
            found[rows], least[rows], place[rows] = other, distance[closer], 0
            walking = walking[place[walking] < k - 1]
        return found, least


def _matrices(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(rows, integers) of the vectors in column 1."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            rows = batch.slice(at, ROWS)
            values = rows.column(1).flatten().to_numpy(zero_copy_only=False)
            yield rows, _integers(values.reshape(rows.num_rows, dims))


def _long(value: int) -> int | None:
    return int(value) if -(1 << 63) <= value < 1 << 63 else None


def first_centroids(kept: DataFrame, k: int, dims: int) -> list[list[int]]:
    """The vectors whose ids have the smallest hashes."""
    hashed = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = kept.orderBy(hashed, "_v").limit(k).select("_v").collect()
    return [[int(v) for v in _integers(np.array(row[0]).reshape(1, dims))[0]] for row in rows]


def moved(kept: DataFrame, centroids: list[list[int]], dims: int) -> list[list[int]]:
    """The means, rounded down, of the vectors nearest to each centroid; a centroid without vectors stays."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Orchard(centroids)
        total = [[0] * dims for _ in centroids]
        count = [0] * len(centroids)
        for _, x in _matrices(batches, dims):
            cluster, _ = search.nearest(x)
            for c in np.unique(cluster):
                mine = x[cluster == c]
                count[c] += len(mine)
                total[c] = [a + int(b) for a, b in zip(total[c], mine.sum(axis=0))]
        cells = [(c, d, Decimal(total[c][d]), count[c]) for c in range(len(centroids)) if count[c] for d in range(dims)]
        columns = list(zip(*cells)) or [(), (), (), ()]
        yield pa.record_batch([pa.array(v, t) for v, t in zip(columns, (pa.int32(), pa.int32(), pa.decimal128(38, 0), pa.int64()))], ["c", "d", "s", "n"])

    parts = kept.mapInArrow(sums, "c int, d int, s decimal(38,0), n long")
    out = [list(c) for c in centroids]
    for row in parts.groupBy("c", "d").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect():  # at most k * dims rows
        out[row.c][row.d] = int(row.s) // row.n
    return out


def assigned(kept: DataFrame, centroids: list[list[int]], dims: int, id_col: str) -> DataFrame:
    """(id, cluster, distance) of every vector."""
    schema = T.StructType([T.StructField(id_col, kept.schema["_id"].dataType), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Orchard(centroids)
        for rows, x in _matrices(batches, dims):
            cluster, distance = search.nearest(x)
            yield pa.record_batch([rows.column(0), pa.array(cluster, pa.int32()), pa.array([_long(v) for v in distance.tolist()], pa.int64())], [id_col, "cluster", "distance"])

    return kept.mapInArrow(nearest, schema)


def centroid_clusters(vectors: DataFrame, *, k: int = 16, rounds: int = 3, dims: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every usable vector."""
    spark = vectors.sparkSession
    kept = vectors.select(quoted(id_col).alias("_id"), quoted(vec_col).alias("_v")).where(usable(F.col("_v"), dims))
    centroids = first_centroids(kept, k, dims)
    for _ in range(rounds if centroids else 0):
        centroids = moved(kept, centroids, dims)
    if not centroids:
        nothing = spark.createDataFrame([], T.StructType([T.StructField(id_col, kept.schema["_id"].dataType)]))
        return nothing.selectExpr("*", "0 as cluster", "0L as distance", "0L as cluster_inertia", "0L as inertia", "'' as centroid_sha256")
    found = stored(assigned(kept, centroids, dims, id_col), "clusters")
    total = F.try_sum(F.col("distance").cast("decimal(38,0)"))
    # a sum over a distance that is null itself is null
    whole = lambda s: F.when(F.count("*") == F.count("distance"), s)
    by_cluster = found.groupBy("cluster").agg(whole(total).alias("_s")).collect()  # at most k rows
    sums = {row["cluster"]: row["_s"] for row in by_cluster}
    everything = None if None in sums.values() else _long(int(sum(sums.values())))
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    facts = spark.createDataFrame([(c, None if s is None else _long(int(s)), everything, digest(centroids[c])) for c, s in sums.items()],
                                  "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select(quoted(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
