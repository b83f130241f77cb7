"""Integer k-means with partial-distance search.

Vectors become integers, floor(scale * x).  A task keeps the centroids, puts the dimensions of greatest variance first
and adds up squared differences block by block: after the first block the centroid that leads is measured in full, and
any other is abandoned as soon as its partial sum is strictly above the best full distance.  Survivors finish all
dimensions, so that the nearest centroid is exact and ties go to the smaller number.  A round sends one row for each
centroid and dimension from each task; vectors are never shuffled.

Edge cases: vectors that are null, of another length, or hold a null or a non-finite component are left out; a null
vec_id is kept, comes last among the first centroids and is returned as null; repeated rows count each for itself, and
rows that share a vec_id are ordered by their components where first centroids are chosen; with fewer vectors than
centroids there are as many centroids as vectors; an empty table gives an empty result; further columns are ignored.
Integers beyond +-2**27 are held there, so that any squared distance fits 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, stash

LIMIT = 2**27
MOST = 2**63 - 1
BATCH = 2048
#: Dimensions that are added between two comparisons.
STEP = 8


def integers(vectors: DataFrame, dims: int = 64, scale: int = 256, column: str = "embedding") -> DataFrame:
    """vec_id and x, the integer components, of the vectors that count."""
    finite = F.forall(column, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    held = lambda v: F.greatest(F.least(F.floor(v.cast("double") * scale), F.lit(LIMIT)), F.lit(-LIMIT)).cast("int")
    held_wide = lambda v: F.when(F.abs(v) < 2.0**40, held(v)).when(v > 0, LIMIT).otherwise(-LIMIT)
    return vectors.where(F.col(column).isNotNull() & (F.size(column) == dims)).where(finite).select("vec_id", F.transform(column, held_wide).alias("x"))


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest centroid of each row.  Columns stand by falling variance."""
    n, k, dims = len(x), len(centroids), x.shape[1]
    part = ((x[:, None, :STEP] - centroids[None, :, :STEP]) ** 2).sum(axis=2)
    lead = part.argmin(axis=1)
    best = ((x - centroids[lead]) ** 2).sum(axis=1)
    i, j = np.nonzero(part <= best[:, None])
    d = part[i, j]
    for at in range(STEP, dims, STEP):
        d = d + ((x[i, at : at + STEP] - centroids[j, at : at + STEP]) ** 2).sum(axis=1)
        on = d <= best[i]
        i, j, d = i[on], j[on], d[on]
    order = np.lexsort((j, d, i))
    first = order[np.append(True, np.diff(i[order]) != 0)[: len(order)]]
    assert k and len(first) == n
    return j[first], d[first]


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index("x"))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, BATCH):
        yield batch.slice(start, BATCH)


def variance_order(points: DataFrame, dims: int) -> np.ndarray:
    """Dimensions by falling variance over all vectors."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, np.zeros(dims), np.zeros(dims)
        for batch in batches:
            x = _matrix(batch, dims).astype(float)
            n, s, q = n + len(x), s + x.sum(axis=0), q + (x**2).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([n] * dims, pa.int64()), pa.array(s), pa.array(q)], ["d", "n", "s", "q"])

    sums = points.select("x").mapInArrow(moments, "d int, n long, s double, q double").groupBy("d").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    spread = {r["d"]: r["q"] / r["n"] - (r["s"] / r["n"]) ** 2 for r in sums.collect()}  # one row a dimension
    return np.array(sorted(range(dims), key=lambda d: (-spread[d], d)))


def first_centroids(points: DataFrame, k: int, prefix: str) -> np.ndarray:
    """The k vectors of smallest hash of prefix and vec_id."""
    hashed = points.withColumn("h", F.sha2(F.concat(F.lit(prefix), F.col("vec_id").cast("string")), 256))
    return np.array([r["x"] for r in hashed.orderBy(F.col("h").asc_nulls_last(), "x").limit(k).collect()], np.int64)  # k rows


def moved(points: DataFrame, centroids: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Centroids after one round: the floor of each cluster's mean; empty ones stay."""
    k, dims = centroids.shape
    sorted_centroids = centroids[:, order]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            for part in _parts(batch):
                x = _matrix(part, dims)
                at, _ = nearest(x[:, order], sorted_centroids)
                by = np.argsort(at, kind="stable")
                starts = np.flatnonzero(np.append(True, np.diff(at[by]) != 0))
                s[at[by][starts]] += np.add.reduceat(x[by], starts, axis=0)
                n += np.bincount(at, minlength=k)
        c, d = np.divmod(np.arange(k * dims), dims)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(d, pa.int32()), pa.array(n[c]), pa.array(s.ravel())], ["c", "d", "n", "s"])

    total = points.select("x").mapInArrow(sums, "c int, d int, n long, s long").groupBy("c", "d").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    out = centroids.copy()
    for r in total.where("n > 0").collect():  # k x dims rows
        out[r["c"], r["d"]] = r["s"] // r["n"]
    return out


def fit(points: DataFrame, k: int = 40, rounds: int = 5, prefix: str = "2:") -> tuple[np.ndarray, np.ndarray]:
    """Centroids, and the order of dimensions for the search, of stored integer vectors."""
    centroids = first_centroids(points, k, prefix)
    if not len(centroids):
        return centroids.reshape(0, 0), np.zeros(0, np.int64)
    order = variance_order(points, centroids.shape[1])
    for _ in range(rounds):
        centroids = moved(points, centroids, order)
    return centroids, order


def assign(points: DataFrame, centroids: np.ndarray, order: np.ndarray) -> DataFrame:
    """vec_id, cluster and squared distance of each vector."""
    sorted_centroids = centroids[:, order]

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                at, d = nearest(_matrix(part, len(order))[:, order], sorted_centroids)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(at, pa.int32()), pa.array(d)], ["vec_id", "cluster", "distance"])

    return points.select("vec_id", "x").mapInArrow(assigned, "vec_id long, cluster int, distance long")


CLUSTERED = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def clusters(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, prefix: str = "2:") -> DataFrame:
    """Each vector with its cluster, its squared distance, the sums of distances, and the hash of its final centroid."""
    spark = vectors.sparkSession
    points = stash(integers(vectors, dims, scale), "vectors")
    centroids, order = fit(points, k, rounds, prefix)
    if not len(centroids):
        return spark.createDataFrame([], CLUSTERED)
    found = stash(assign(points, centroids, order), "assigned")
    discard(points)
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    held = lambda v: min(v, MOST)
    rows = [(c, held(s), held(sum(sums.values())), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in sums.items()]
    return found.join(F.broadcast(spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
