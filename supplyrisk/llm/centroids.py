"""Centroid clustering of integer vectors: exact k-means by equal-average equal-variance search.

Centroids are sorted by their component sum (the mean times the number of
components d).  For a vector x the search starts at the centroids next to
x's own sum and goes outward in both directions.  With S the sum and
V^2 = d * sum(x_i^2) - S^2 of a vector,

    d * |x - c|^2  >=  (S_x - S_c)^2 + (V_x - V_c)^2,

so a direction ends at the first centroid whose sum alone is too far, a
centroid in between is rejected by its deviation, and only the others have
their distance computed, in integers.  Comparisons with sums are exact;
the square roots of the deviation test carry a margin that only lets more
centroids through.  Ties go to the smaller centroid number.

Every round is one pass over the vectors, without a shuffle of them: a
task returns, per centroid, the count and the componentwise sums of its
vectors.  The driver holds the centroids alone (k times d integers).

Defined cases: vectors of another length, null vectors and vectors with a
null or non-finite component are left out; null ids take part, and as
seeds come last; repeated rows are vectors of their own; fewer vectors
than centroids give as many centroids as there are vectors; an empty table
gives an empty result; other columns are ignored.  Components beyond
2^30 / d in magnitude raise an error, as squared distances would no longer
fit 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supplyrisk.plans import materialize


def whole_vectors(rows: DataFrame, vector: str, dims: int) -> Column:
    """Does the row's vector have ``dims`` components, all finite?"""
    x = F.col(vector)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce((F.size(x) == dims) & finite, F.lit(False))


def integer_vectors(rows: DataFrame, scale: float, dims: int, vector: str = "embedding") -> DataFrame:
    """(vec_id, v): whole vectors with each component x as floor(scale * x), x as double."""
    kept = rows.filter(whole_vectors(rows, vector, dims))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"),
                       F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("v"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) and max(-int(flat.min()), int(flat.max())) > 2**30 // dims:
        raise ValueError(f"components beyond {2**30 // dims} in magnitude: squared distances would not fit 64 bits")
    return flat.reshape(-1, dims)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) of every row; ties: the smaller number."""
    k, d = centroids.shape
    sums = centroids.sum(1)
    number = np.lexsort((np.arange(k), sums))
    c, sums = centroids[number], sums[number]
    deviation = np.sqrt((d * (c * c).sum(1) - sums * sums).astype(np.float64))
    s = x.sum(1)
    v = np.sqrt((d * (x * x).sum(1) - s * s).astype(np.float64))
    best, best_number = np.full(len(x), 2**62 // d), np.full(len(x), k)
    right = np.searchsorted(sums, s)
    left = right - 1
    far = np.int64(2**31)   # sums lie within 2^30
    alive = np.arange(len(x))
    while len(alive):
        at_left, at_right = left[alive], right[alive]
        gap_left = np.where(at_left >= 0, s[alive] - sums[np.maximum(at_left, 0)], far)
        gap_right = np.where(at_right < k, sums[np.minimum(at_right, k - 1)] - s[alive], far)
        go_left = gap_left <= gap_right
        gap = np.where(go_left, gap_left, gap_right)
        go = (gap < far) & (gap * gap <= d * best[alive])   # the nearer side's sum bounds both sides
        alive, gap, go_left = alive[go], gap[go], go_left[go]
        pick = np.where(go_left, left[alive], right[alive])
        left[alive] -= go_left
        right[alive] += ~go_left
        bound = gap.astype(np.float64) ** 2 + (v[alive] - deviation[pick]) ** 2
        near = bound * (1 - 1e-9) - 1 <= d * best[alive].astype(np.float64)
        row, pick = alive[near], pick[near]
        diff = x[row] - c[pick]
        distance = (diff * diff).sum(1)
        better = (distance < best[row]) | ((distance == best[row]) & (number[pick] < best_number[row]))
        best[row[better]], best_number[row[better]] = distance[better], number[pick[better]]
    return best_number, best


def seeds(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest sha256 of ``<seed>:<vec_id>``, in that order."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(mark.asc_nulls_last(), "v").limit(k).select("v").collect()   # k rows
    return np.array([r["v"] for r in rows], np.int64)


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: each non-empty one becomes the componentwise floor(sum / count)."""
    k, d = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, d), np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), d)
            cluster = nearest(x, centroids)[0]
            order = np.argsort(cluster, kind="stable")
            if len(order):
                ends, first = np.unique(cluster[order], return_index=True)
                count[ends] += np.diff(np.r_[first, len(order)])
                total[ends] += np.add.reduceat(x[order], first, axis=0)
        has = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(has), "n": pa.array(count[has]),
                                          "s": pa.array(list(total[has]), pa.list_(pa.int64()))})

    parts = vectors.select("v").mapInArrow(sums, "cluster long, n long, s array<long>")
    flat = parts.select("cluster", "n", F.posexplode("s").alias("place", "x")).groupBy("cluster", "place") \
                .agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    out = centroids.copy()
    for r in flat.collect():   # k * d rows
        out[r["cluster"], r["place"]] = r["x"] // r["n"]
    return out


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance = nearest(_matrix(batch.column(1), centroids.shape[1]), centroids)
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column(0), "cluster": pa.array(cluster.astype(np.int32)),
                                              "distance": pa.array(distance)})

    return vectors.select("vec_id", "v").mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """k-means over integer vectors (``integer_vectors``): (vec_id, cluster, distance) and the final centroids."""
    centroids = seeds(vectors, k, seed)
    if not len(centroids):
        return vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    for _ in range(rounds):
        centroids = moved(vectors, centroids)
    return assigned(vectors, centroids), centroids


def report(vectors: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1) -> DataFrame:
    """Per vector: its cluster and squared distance, the distances summed over its cluster and over all
    vectors, and the sha256 of its centroid's components joined by commas."""
    rows, centroids = cluster(vectors, k, rounds, seed)
    rows = materialize(rows, name="assigned")
    names = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    digests = vectors.sparkSession.createDataFrame(names, "cluster int, centroid_sha256 string")
    sums = materialize(rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")), name="inertia")
    whole = sums.select(F.sum("cluster_inertia")).scalar()
    per = sums.join(digests, "cluster").withColumn("inertia", whole)
    # one row per centroid, k at most
    return rows.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia",
                                                         "centroid_sha256")
