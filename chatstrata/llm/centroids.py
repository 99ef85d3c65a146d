"""Centroid clustering in exact integers; the nearest centroid is found by the threshold algorithm.

Each component has a list of the centroids in the order of their values there. For a vector, all
lists are walked outward from its own value at once: each step takes the next nearest centroid of
every list, and a centroid met for the first time gets its exact distance. The sum of the squared
gaps at the frontiers is the least that any centroid not yet met can have, so the walk ends as soon
as that sum is strictly above the best exact distance: a tie is still met, and the smaller number wins.

Vectors stay in their partitions. A round sends `count` x dimensions partial sums per task, added up
by Spark as exact numbers; only centroids, whose number is a parameter, come to the driver.

Defined cases: a vector that is null, has another number of components, or a null, NaN or infinite one is
left out. Rows that repeat a vec_id are vectors of their own; a null vec_id is hashed as the empty text.
Vectors of equal hash are ordered by their components. With fewer vectors than `count`, each is a centroid.
An empty table gives no rows. Components too large for 64-bit squares are calculated in Python's integers;
a distance or inertia beyond 64 bits is null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatstrata.session import staged

DIMENSIONS, SCALE = 64, 64
COUNT, ROUNDS, SEED = 16, 3, "1"
# Vectors walked together; with 64 dimensions an array of theirs has 2 MB.
BLOCK = 4096
# Below this size of a component, 64 squared differences add up to less than 2**63.
SMALL = 1 << 27
# Partial sums travel as signed digits to this base, so that they add up exactly whatever their size.
DIGIT = 40
LONG_MAX = (1 << 63) - 1


def usable(embedding: Column, dimensions: int = DIMENSIONS) -> Column:
    """Exactly so many components, all finite numbers."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return embedding.isNotNull() & (F.size(embedding) == dimensions) & ~bad


def scaled(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) as integers: 64-bit ones if their squares fit, else Python's."""
    with np.errstate(over="ignore"):
        floors = np.floor(values * scale)
    if not len(floors) or np.abs(floors).max() < SMALL:
        return floors.astype(np.int64)
    # whole numbers first: the product may be beyond the doubles
    exact = [math.floor(x * scale) if abs(x) < 1e15 else int(x) * scale for x in values.ravel().tolist()]
    whole = np.empty(len(exact), object)
    whole[:] = exact
    return whole.reshape(values.shape)


class Centroids:
    """The sorted lists of one round's centroids."""

    def __init__(self, points: list[list[int]]):
        small = all(abs(x) < SMALL for point in points for x in point)
        self.points = np.array(points, np.int64 if small else object)
        order = np.argsort(self.points, axis=0, kind="stable")
        self.order = np.ascontiguousarray(order.T)
        self.values = np.ascontiguousarray(np.take_along_axis(self.points, order, axis=0).T)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of the nearest centroid of each vector, and the squared distance."""
        if self.points.dtype == object or vectors.dtype == object:
            vectors = vectors.astype(object)
        cluster = np.zeros(len(vectors), np.int64)
        distance = np.zeros(len(vectors), vectors.dtype)
        for first in range(0, len(vectors), BLOCK):
            part = slice(first, first + BLOCK)
            cluster[part], distance[part] = self._walk(vectors[part])
        return cluster, distance

    def _walk(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count, dimensions = self.points.shape
        lists = np.arange(dimensions)
        after = np.empty(vectors.shape, np.int64)
        for d in range(dimensions):
            after[:, d] = np.searchsorted(self.values[d], vectors[:, d])
        before = after - 1
        seen = np.zeros((len(vectors), count), bool)
        who = np.full(len(vectors), -1, np.int64)
        best = np.zeros(len(vectors), vectors.dtype)
        walking = np.arange(len(vectors))
        while len(walking):
            own, low, high = vectors[walking], before[walking], after[walking]
            gap_low = own - self.values[lists, np.maximum(low, 0)]
            gap_high = self.values[lists, np.minimum(high, count - 1)] - own
            down = (high >= count) | ((low >= 0) & (gap_low <= gap_high).astype(bool))
            met = self.order[lists, np.where(down, low, high)]
            before[walking], after[walking] = low - down, high + ~down
            was = seen[walking]
            now = was.copy()
            now[np.arange(len(walking))[:, None], met] = True
            seen[walking] = now
            for number in range(count):
                rows = walking[now[:, number] & ~was[:, number]]
                if not len(rows):
                    continue
                apart = vectors[rows] - self.points[number]
                exact = (apart * apart).sum(axis=1)
                closer = (who[rows] < 0) | (exact < best[rows]).astype(bool) | ((exact == best[rows]).astype(bool) & (number < who[rows]))
                who[rows[closer]], best[rows[closer]] = number, exact[closer]
            gap = np.where(down, gap_low, gap_high)
            frontier = (gap * gap).sum(axis=1)
            walking = walking[~(now.all(axis=1) | (frontier > best[walking]).astype(bool))]
        return who, best


def _vectors(batch: pa.RecordBatch, column: int, scale: int) -> np.ndarray:
    rows = batch.column(column)
    flat = rows.flatten().to_numpy(zero_copy_only=False)
    return scaled(flat.reshape(len(rows), -1), scale)


def digits(value: int) -> list[int]:
    """The digits of an integer to the base 2**DIGIT, lowest first; the last one carries the sign."""
    found = []
    while not -(1 << DIGIT) <= value < 1 << DIGIT:
        found.append(value & ((1 << DIGIT) - 1))
        value >>= DIGIT
    return [*found, value]


def moved(kept: DataFrame, points: list[list[int]], scale: int) -> list[list[int]]:
    """The centroids after one round: floor means of their vectors, those without vectors as they were."""
    names = ["cluster", "dimension", "digit", "part"]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = Centroids(points)
        width = centroids.points.shape[1]
        # the last column counts the vectors
        totals = np.zeros((len(points), width + 1), object)
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _vectors(batch, 0, scale)
            cluster, _ = centroids.nearest(vectors)
            for number in np.unique(cluster).tolist():
                own = vectors[cluster == number]
                totals[number, :width] += own.sum(axis=0).astype(object)
                totals[number, width] += len(own)
        rows = [
            (number, d, digit, part)
            for number, row in enumerate(totals.tolist())
            if row[width]
            for d, value in enumerate(row)
            for digit, part in enumerate(digits(int(value)))
        ]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)

    parts = kept.select("embedding").mapInArrow(summed, ", ".join(f"{name} long" for name in names))
    sums = parts.groupBy(*names[:3]).agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("part")).collect()
    width = len(points[0])
    totals: dict[int, list[int]] = {}
    for r in sums:
        totals.setdefault(r["cluster"], [0] * (width + 1))[r["dimension"]] += int(r["part"]) << (DIGIT * r["digit"])
    return [
        [value // totals[number][width] for value in totals[number][:width]] if number in totals else point
        for number, point in enumerate(points)
    ]


@dataclass
class Clustering:
    """`rows`: vec_id, cluster, distance; `clusters`: cluster, cluster_inertia, inertia, components; `points` as lists."""

    rows: DataFrame
    clusters: DataFrame
    points: list[list[int]]


def first_points(kept: DataFrame, count: int, seed: str, scale: int) -> list[list[int]]:
    """The vectors of the `count` smallest sha-256 of `seed:vec_id`, in that order."""
    name = F.coalesce(F.col("vec_id").cast("string"), F.lit(""))
    hashed = kept.select(F.sha2(F.concat(F.lit(f"{seed}:"), name), 256).alias("hash"), "embedding")
    first = hashed.orderBy("hash", "embedding").limit(count).collect()
    return [scaled(np.array(r["embedding"], np.float64), scale).tolist() for r in sorted(first, key=lambda r: (r["hash"], r["embedding"]))]


def cluster_vectors(
    rows: DataFrame, count: int = COUNT, rounds: int = ROUNDS, seed: str = SEED, dimensions: int = DIMENSIONS, scale: int = SCALE
) -> Clustering:
    """The vectors (vec_id, embedding) clustered around `count` centroids, which move `rounds` times."""
    spark = rows.sparkSession
    kept = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(usable(F.col("embedding"), dimensions))
    points = first_points(kept, count, seed, scale)
    for _ in range(rounds if points else 0):
        points = moved(kept, points, scale)
    key = kept.schema["vec_id"].dataType.simpleString()

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = Centroids(points) if points else None
        for batch in batches:
            if not batch.num_rows:
                continue
            cluster, distance = centroids.nearest(_vectors(batch, 1, scale))
            if distance.dtype == object:
                distance = [d if d <= LONG_MAX else None for d in distance.tolist()]
            columns = [batch.column(0), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance"])

    found = staged(kept.mapInArrow(assigned, f"vec_id {key}, cluster int, distance long"), "clusters")
    # decimals, as a sum may pass 64 bits; a distance that is null makes its sums null
    sums = found.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"), F.count_if(F.col("distance").isNull()).alias("beyond")
    )
    totals = {r["cluster"]: None if r["beyond"] else int(r["total"]) for r in sums.collect()}
    whole = None if None in totals.values() else sum(totals.values())
    table = [(number, _long(totals.get(number, 0)), _long(whole), list(map(str, point))) for number, point in enumerate(points)]
    clusters = spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, components array<string>")
    return Clustering(found, clusters, points)


def _long(value: int | None) -> int | None:
    return value if value is not None and value <= LONG_MAX else None


def digest(components: Column) -> Column:
    """Lowercase hex sha-256 of decimal components joined by commas."""
    return F.sha2(F.array_join(components, ","), 256)
