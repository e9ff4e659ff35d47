"""Centroid clustering in whole numbers with equal-average equal-variance search.

Vectors become integers and stay so: sums, centroids and squared distances are exact, and runs agree
whatever the partitions. Each round is one pass over the vectors. The centroids, few rows of fixed
size, are sorted by the sum of their components and sent to all tasks. A vector starts at the centroid
next to its own sum and walks outward on both sides. With d components, sum S and deviation
V = sqrt(d * squares - S^2),

    d * distance >= (S_x - S_c)^2 + (V_x - V_c)^2,

so a side ends where the first term alone exceeds d times the best distance so far, and a centroid
whose both terms exceed it is passed over. The tests are in floating point with a margin, so they only
ever spare work. Whoever is left gets the exact integer distance, and ties go to the smaller number,
as bounds must be exceeded and not just met.

A task sends one partial sum per centroid and component; Spark adds them up, and the driver sees
centroids x components rows.

Defined results: vectors that are null, of another length, or with null, NaN or infinite components
take no part. Repeated rows are vectors of their own; a null id counts as empty text in the hash that
picks the first centroids, and rows of equal hash follow in the order of their components. With fewer
vectors than centroids there are as many centroids as vectors; an empty table gives no rows. Scaled
components of 2^27 or more in size are refused, as their distances don't fit a long. Other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetrove.session import ship_package, write_scratch

from .common import slices

LARGEST = 1 << 27
ENDED = np.iinfo(np.int64).max   # the gap of a side without centroids left


@dataclass(frozen=True)
class ClusterConfig:
    clusters: int = 8
    rounds: int = 10
    scale: int = 1024
    components: int = 64
    seed: str = "3:"


def integer_vectors(embeddings: DataFrame, config: ClusterConfig) -> DataFrame:
    """(vec_id, x): the vectors that take part, as integers."""
    x = F.col("embedding")
    fit = (F.size(x) == config.components) & F.forall(
        x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) != float("inf")))
    whole = F.transform(x, lambda v: F.floor(v.cast("double") * config.scale).cast("long"))
    return embeddings.filter(F.coalesce(fit, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("x"))


def matrix(column: pa.Array, components: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, components)


class NearestCentroid:
    """Exact nearest centroid of integer vectors."""

    def __init__(self, centroids: np.ndarray):
        sums = centroids.sum(axis=1)
        self.order = np.lexsort((np.arange(len(centroids)), sums))
        self.centroids, self.sums = centroids[self.order], sums[self.order]
        self.deviations = self.deviation(self.centroids, self.sums)
        self.finished = 0   # distances computed in full

    @staticmethod
    def deviation(rows: np.ndarray, sums: np.ndarray) -> np.ndarray:
        x = rows.astype(np.float64)
        return np.sqrt(np.maximum(rows.shape[1] * np.einsum("ij,ij->i", x, x) - sums.astype(np.float64) ** 2, 0))

    def search(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of the nearest centroid of each row."""
        n, d, k = len(rows), rows.shape[1], len(self.centroids)
        if n and max(int(rows.max()), -int(rows.min())) >= LARGEST:
            raise ValueError(f"scaled components must be below {LARGEST} in size")
        sums = rows.sum(axis=1)
        deviations = self.deviation(rows, sums)
        # Rounding of squares of up to d * LARGEST^2 is far below this share of them.
        slack = 1e-9 * (deviations + self.deviations.max(initial=0) + 1) ** 2
        best = np.full(n, np.iinfo(np.int64).max)
        number = np.full(n, k)
        right = np.searchsorted(self.sums, sums)
        left = right - 1
        at_work = np.arange(n)
        while len(at_work):
            lo, hi = left[at_work], right[at_work]
            gap_lo = np.where(lo >= 0, sums[at_work] - self.sums[np.maximum(lo, 0)], ENDED)
            gap_hi = np.where(hi < k, self.sums[np.minimum(hi, k - 1)] - sums[at_work], ENDED)
            down = gap_lo <= gap_hi
            gap, at = np.where(down, gap_lo, gap_hi), np.where(down, lo, hi)
            # The nearer side is looked at first, so where it is out, the other is too.
            limit = best[at_work].astype(np.float64) * d * (1 + 1e-9)
            go = (gap < ENDED) & (gap.astype(np.float64) ** 2 <= limit)
            at_work, at, gap, limit, down = at_work[go], at[go], gap[go], limit[go], down[go]
            left[at_work[down]] -= 1
            right[at_work[~down]] += 1
            far = gap.astype(np.float64) ** 2 + (deviations[at_work] - self.deviations[at]) ** 2
            near = far <= limit + slack[at_work]
            rest, c = at_work[near], at[near]
            difference = rows[rest] - self.centroids[c]
            distance = np.einsum("ij,ij->i", difference, difference)
            self.finished += len(rest)
            name = self.order[c]
            wins = (distance < best[rest]) | ((distance == best[rest]) & (name < number[rest]))
            best[rest[wins]], number[rest[wins]] = distance[wins], name[wins]
        return number, best


def first_centroids(vectors: DataFrame, config: ClusterConfig) -> np.ndarray:
    key = F.sha2(F.concat(F.lit(config.seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(key.alias("key"), "x").orderBy("key", "x").limit(config.clusters).collect()
    return np.array([r.x for r in rows], np.int64).reshape(-1, config.components)


def one_round(vectors: DataFrame, centroids: np.ndarray, config: ClusterConfig) -> np.ndarray:
    """The floored means of the vectors nearest to each centroid; a centroid without vectors stays."""
    d = config.components

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = NearestCentroid(centroids)
        sums, counts = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for batch in batches:
            for part in slices(batch):
                rows = matrix(part.column("x"), d)
                number, _ = near.search(rows)
                order = np.argsort(number, kind="stable")
                found, begins, n = np.unique(number[order], return_index=True, return_counts=True)
                if len(found):
                    sums[found] += np.add.reduceat(rows[order], begins, axis=0)
                    counts[found] += n
        has = np.nonzero(counts)[0]
        yield pa.RecordBatch.from_pydict({
            "cluster": pa.array(np.repeat(has, d), pa.int32()), "place": pa.array(np.tile(np.arange(d), len(has)), pa.int32()),
            "total": pa.array(sums[has].ravel()), "n": pa.array(np.repeat(counts[has], d)),
        })

    parts = vectors.select("x").mapInArrow(partial, "cluster int, place int, total long, n long")
    out = centroids.copy()
    for r in parts.groupBy("cluster", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        out[r.cluster, r.place] = r.total // r.n
    return out


def fit(vectors: DataFrame, config: ClusterConfig) -> np.ndarray:
    centroids = first_centroids(vectors, config)
    for _ in range(config.rounds):
        moved = one_round(vectors, centroids, config) if len(centroids) else centroids
        if np.array_equal(moved, centroids):  # all further rounds would give the same
            break
        centroids = moved
    return centroids


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of each vector."""
    ship_package(vectors.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = NearestCentroid(centroids)
        for batch in batches:
            for part in slices(batch):
                number, distance = near.search(matrix(part.column("x"), centroids.shape[1]))
                yield pa.RecordBatch.from_pydict({
                    "vec_id": part.column("vec_id"), "cluster": pa.array(number, pa.int32()), "distance": pa.array(distance)})

    return vectors.select("vec_id", "x").mapInArrow(each, "vec_id long, cluster int, distance long")


def cluster(embeddings: DataFrame, config: ClusterConfig = ClusterConfig()) -> DataFrame:
    """Each vector with its cluster, squared distance, the inertias, and the hash of its final centroid."""
    spark = embeddings.sparkSession
    ship_package(spark)
    vectors = write_scratch(integer_vectors(embeddings, config), "integer-vectors")
    centroids = fit(vectors, config)
    assigned = write_scratch(assign(vectors, centroids), "assigned")
    sums = dict(assigned.groupBy("cluster").agg(F.sum("distance")).collect())  # one row per centroid
    total = sum(sums.values())
    per_cluster = spark.createDataFrame(
        [(i, sums.get(i, 0), total, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(per_cluster), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
