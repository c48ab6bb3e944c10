"""Centroid clustering in exact integers, the nearest centroid found by the threshold algorithm.

Every dimension has a list of the centroids sorted by their value there. From a vector's own value each list is
walked outward, one entry of every dimension a step; a centroid met for the first time gets its exact distance.
The centroids not met yet are at least as far off in each dimension as the entry reached there, so the search
stops when the sum of the squared frontier distances strictly exceeds the best exact distance (strictly, since a
tie goes to the smaller number), or when every centroid has been met.

Spark holds the vectors; a round is one scan that sends one row of sums per task, cluster and dimension into an
aggregation. The driver holds the centroids alone (``k`` x dimensions integers).

Defined cases: vectors that are null, of another length than ``dims``, or hold null or non-finite components are
left out; with fewer than ``k`` vectors each starts as a centroid; a null id hashes as ``null`` and repeated ids
are vectors of their own, of which those with smaller components come first; a table without usable vectors gives
no rows; other columns are ignored, whatever their names. A component beyond ``LARGEST`` after scaling raises
an error, since a squared distance would no longer fit 64 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialize

#: Integer steps per unit of a component.
SCALE = 256
#: Largest magnitude of a scaled component: 64 squared differences of twice that still fit 63 bits.
LARGEST = 1 << 27
#: Vectors that one step of the walk handles together.
ROWS = 4096
FAR = np.iinfo(np.int64).max


class SortedCentroids:
    """The centroids with one sorted list per dimension."""

    def __init__(self, centres: np.ndarray):
        self.centres = np.ascontiguousarray(centres, dtype=np.int64)
        self.order = np.argsort(self.centres, axis=0, kind="stable")
        self.values = np.take_along_axis(self.centres, self.order, axis=0)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number and squared distance of the nearest centroid of each row, and how many distances were computed."""
        parts = [self._nearest(x[i:i + ROWS]) for i in range(0, len(x), ROWS)]
        if not parts:
            return np.empty(0, np.int64), np.empty(0, np.int64), 0
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), sum(p[2] for p in parts)

    def _nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        k, dims = self.centres.shape
        dim = np.arange(dims)
        right = np.stack([np.searchsorted(self.values[:, d], x[:, d]) for d in dim], axis=1)
        left = right - 1
        best, number = np.full(len(x), FAR), np.full(len(x), k)
        met = np.zeros((len(x), k), bool)
        rows, scored = np.arange(len(x)), 0
        while len(rows):
            below = np.where(left >= 0, x - self.values[np.maximum(left, 0), dim], FAR)
            above = np.where(right < k, self.values[np.minimum(right, k - 1), dim] - x, FAR)
            lower = below <= above
            frontier = np.minimum(below, above)
            entry = self.order[np.where(lower, left, right), dim]
            left, right = left - lower, right + ~lower
            # exact distances of the centroids met for the first time
            fresh = np.zeros((len(x), k), bool)
            fresh[np.arange(len(x))[:, None], entry] = True
            fresh &= ~met
            met |= fresh
            row, centre = np.nonzero(fresh)
            apart = x[row] - self.centres[centre]
            scored += len(row)
            found = np.full((len(x), k), FAR)
            found[row, centre] = np.einsum("ij,ij->i", apart, apart)
            first = found.argmin(axis=1)  # the smallest number among equals
            least = found[np.arange(len(x)), first]
            old, old_number = best[rows], number[rows]
            better = (least < old) | ((least == old) & (first < old_number))
            best[rows], number[rows] = np.where(better, least, old), np.where(better, first, old_number)
            going = ((frontier * frontier).sum(axis=1) <= best[rows]) & ~met.all(axis=1)
            rows, x, left, right, met = rows[going], x[going], left[going], right[going], met[going]
        return number, best, scored


def integer_vectors(df: DataFrame, dims: int, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id, x``: usable vectors as integers ``floor(SCALE * component)``."""
    e = F.col(embedding).cast("array<double>")
    finite = F.forall(e, lambda v: v.isNotNull() & (F.abs(v) < F.lit(float("inf"))))
    scaled = F.transform(e, lambda v: F.floor(v * SCALE).cast("long"))
    kept = df.filter(F.col(embedding).isNotNull() & (F.size(embedding) == dims) & finite)
    large = F.exists("x", lambda v: (v > LARGEST) | (v < -LARGEST))
    return kept.select(F.col(vec_id).cast("long").alias("vec_id"), scaled.alias("x")).withColumn(
        "x", F.when(large, F.raise_error(F.lit(f"centroids: a scaled component exceeds {LARGEST}")).cast("array<long>"))
        .otherwise(F.col("x")))


def first_centres(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The ``k`` vectors with the smallest hash of ``seed:id``, in that order."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null")))
    rows = vectors.select(F.sha2(name, 256).alias("h"), "x").orderBy("h", "x").limit(k).collect()
    return np.array([r["x"] for r in rows], np.int64)


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), dims)


def _sums(vectors: DataFrame, lists: SortedCentroids) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of each cluster and their componentwise sums, exact."""
    k, dims = lists.centres.shape

    def task(batches):
        total = np.zeros((k, dims + 1), np.int64)
        for batch in batches:
            x = _matrix(batch, dims)
            number = lists.nearest(x)[0]
            by = np.argsort(number, kind="stable")
            found, start = np.unique(number[by], return_index=True)
            if len(found):
                total[found, :dims] += np.add.reduceat(x[by], start, axis=0)
                total[found, dims] += np.diff(np.append(start, len(x)))
        used = np.flatnonzero(total[:, dims])
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used].tolist(), pa.list_(pa.int64()))],
                                         names=["cluster", "sums"])

    rows = (map_batches(vectors.select("x"), task, "cluster int, sums array<long>")
            .select("cluster", F.posexplode("sums").alias("at", "v"))
            .groupBy("cluster", "at").agg(F.sum("v").alias("v")).collect())  # k x (dims + 1) at most
    out = np.zeros((k, dims + 1), np.int64)
    for r in rows:
        out[r["cluster"], r["at"]] = r["v"]
    return out[:, dims], out[:, :dims]


def cluster(df: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, seed: str = "2") -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` for every usable vector."""
    spark = df.sparkSession
    schema = "vec_id long, cluster int, distance long"
    vectors = materialize(integer_vectors(df, dims), "vectors")
    centres = first_centres(vectors, k, seed)
    if not len(centres):
        return spark.createDataFrame([], schema + ", cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        n, sums = _sums(vectors, SortedCentroids(centres))
        centres = np.where((n > 0)[:, None], sums // np.maximum(n, 1)[:, None], centres)
    lists = SortedCentroids(centres)

    def assign(batches):
        for batch in batches:
            number, distance, _ = lists.nearest(_matrix(batch, dims))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(number.astype(np.int32)), pa.array(distance)],
                                             names=["vec_id", "cluster", "distance"])

    found = materialize(map_batches(vectors, assign, schema), "clusters")
    inertia = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres.tolist()]
    per_cluster = spark.createDataFrame([(c, s, sum(inertia.values()), digest[c]) for c, s in inertia.items()],
                                        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(per_cluster), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
