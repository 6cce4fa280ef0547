"""Exact k-means on integer vectors, with centroids filtered in PCA-rotated coordinates.

A vector is stored with its leading coordinates in the rotated space and the norm of the rest.
For a vector and a centroid, the distance of the leading coordinates plus the squared difference
of the two norms cannot exceed the squared distance. So the centroid with the lowest bound is
measured first, and only centroids whose bound is no larger than that distance are measured at
all, in integers. The rotation comes from the covariance of all vectors; it decides what is cheap,
never what is nearest, as bounds are lowered by more than their rounding errors.

Counts and sums of the clusters are integers made in the tasks; the driver sees k rows a round.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

WIDTH = 64
SCALE = 256
#: Rotated coordinates that are stored.
LEADING = 24
#: Components beyond this size have squared distances that do not fit a long.
LARGEST = 1 << 26
#: Vectors measured together.
BLOCK = 4096
#: What bounds are lowered by, as part of the squared norms: thousands of times the rounding error.
SLACK = 1e-9


class Clusters(NamedTuple):
    centroids: np.ndarray  # int64, one row per cluster
    assigned: DataFrame  # vec_id, cluster, distance


def integer_vectors(rows: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """``vec_id`` and ``v``: the kept vectors, floor(SCALE * x) of every component."""
    x = F.col(embedding).cast("array<double>")
    usable = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST / SCALE))
    return rows.where((F.size(embedding) == WIDTH) & usable).select(
        F.col(vec_id).alias("vec_id"), F.transform(x, lambda c: F.floor(c * SCALE).cast("int")).alias("v")
    )


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def rotation(vectors: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and principal axes (columns, widest first) of all vectors; row sums are made in the tasks."""

    def work(batches):
        import pyarrow as pa

        n, first, second = 0, np.zeros(WIDTH), np.zeros((WIDTH, WIDTH))
        for batch in batches:
            v = _matrix(batch.column(0)).astype(float)
            n, first, second = n + len(v), first + v.sum(axis=0), second + v.T @ v
        sums = np.vstack([second, first, np.full(WIDTH, float(n))])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(WIDTH + 2), WIDTH)), pa.array(np.tile(np.arange(WIDTH), WIDTH + 2)), pa.array(sums.reshape(-1))],
            ["i", "j", "x"],
        )

    cells = vectors.select("v").mapInArrow(work, "i bigint, j bigint, x double")
    table = cells.groupBy("i", "j").agg(F.sum("x").alias("x")).toPandas()
    sums = np.zeros((WIDTH + 2, WIDTH))
    sums[table["i"].to_numpy(dtype=int), table["j"].to_numpy(dtype=int)] = table["x"].to_numpy(dtype=float)
    n = max(1.0, sums[-1, 0])
    mean = sums[-2] / n
    _, axes = np.linalg.eigh(sums[:WIDTH] / n - np.outer(mean, mean))
    return mean, axes[:, ::-1]


def rotated(v: np.ndarray, mean: np.ndarray, axes: np.ndarray, leading: int) -> np.ndarray:
    """Leading rotated coordinates of integer vectors, then the norm of the other coordinates."""
    turned = (v - mean) @ axes
    return np.column_stack([turned[:, :leading], np.sqrt((turned[:, leading:] ** 2).sum(axis=1))])


def nearest(v: np.ndarray, short: np.ndarray, centroids: np.ndarray, short_centroids: np.ndarray):
    """Nearest centroid of every vector, its squared distance, and how many distances were measured.

    ``short`` is ``rotated(v)``, so the squared distance of two short rows is the lower bound.
    Of centroids equally near the one with the smaller number is taken.
    """
    squares = (short**2).sum(axis=1)[:, None] + (short_centroids**2).sum(axis=1)[None, :]
    bound = squares - 2 * (short @ short_centroids.T) - SLACK * squares - 1e-6
    first = bound.argmin(axis=1)
    best = ((v - centroids[first]) ** 2).sum(axis=1)
    cluster, measured = first.copy(), len(v)
    left = bound <= best[:, None]
    left[np.arange(len(v)), first] = False
    for j in range(len(centroids)):
        rows = np.flatnonzero(left[:, j])
        if len(rows):
            apart = ((v[rows] - centroids[j]) ** 2).sum(axis=1)
            better = (apart < best[rows]) | ((apart == best[rows]) & (j < cluster[rows]))
            best[rows[better]], cluster[rows[better]] = apart[better], j
            measured += len(rows)
    return cluster, best, measured


def _assignments(batch, centroids, short_centroids):
    """Blocks (begin, vectors, cluster, distance, measured) of an Arrow batch of ``v`` and ``short``."""
    v = _matrix(batch.column("v"))
    short = batch.column("short").flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)
    for at in range(0, len(v), BLOCK):
        part = v[at : at + BLOCK]
        yield at, part, *nearest(part, short[at : at + BLOCK], centroids, short_centroids)


def _sums(vectors: DataFrame, centroids: np.ndarray, short: np.ndarray):
    """Vectors per cluster and their componentwise sums, exact."""
    k = len(centroids)

    def work(batches):
        import pyarrow as pa

        count, total = np.zeros(k, dtype=np.int64), np.zeros((k, WIDTH), dtype=np.int64)
        for batch in batches:
            for _, part, cluster, _, _ in _assignments(batch, centroids, short):
                count += np.bincount(cluster, minlength=k)
                np.add.at(total, cluster, part)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(used, WIDTH)), pa.array(np.tile(np.arange(WIDTH), len(used))),
                pa.array(np.repeat(count[used], WIDTH)), pa.array(total[used].reshape(-1)),
            ],
            ["cluster", "place", "n", "total"],
        )

    cells = vectors.select("v", "short").mapInArrow(work, "cluster bigint, place bigint, n bigint, total bigint")
    return cells.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).toPandas()


def cluster_vectors(
    rows: DataFrame, k: int = 40, rounds: int = 5, seed: str = "2",
    vec_id: str = "vec_id", embedding: str = "embedding", leading: int = LEADING,
) -> Clusters:
    """k-means over the vectors of ``rows`` in integers: the same result on any cluster.

    Kept are vectors of WIDTH components, none null or non-finite; components of 2**18 and more
    count as non-finite, since their squared distances in 256ths do not fit a long. Centroids
    start as the k vectors with the smallest sha256 of ``seed:vec_id`` (a null id as the empty
    text; equal ids by vector). A round assigns all vectors, ties to the smaller number, and moves
    every non-empty centroid to the floor of the mean. Repeated rows count as often as they occur.
    With fewer than k vectors there are fewer clusters; an empty table gives none. Other columns
    are ignored.
    """
    kept = stored(integer_vectors(rows, vec_id, embedding), "vectors")
    place = F.sha2(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    begin = kept.orderBy(place, "v").limit(k).select("v").collect()
    centroids = np.array([row["v"] for row in begin], dtype=np.int64).reshape(len(begin), WIDTH)
    kind = dict(kept.dtypes)["vec_id"]
    if not len(centroids):
        none = kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance"))
        return Clusters(centroids, none)
    mean, axes = rotation(kept)

    def shorten(batches):
        import pyarrow as pa

        for batch in batches:
            short = rotated(_matrix(batch.column("v")), mean, axes, leading)
            offsets = pa.array(np.arange(len(short) + 1, dtype=np.int32) * (leading + 1))
            lists = pa.ListArray.from_arrays(offsets, pa.array(short.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), lists], ["vec_id", "v", "short"])

    vectors = stored(kept.mapInArrow(shorten, f"vec_id {kind}, v array<int>, short array<double>"), "rotated")
    for _ in range(rounds):
        found = _sums(vectors, centroids, rotated(centroids, mean, axes, leading))
        at = found["cluster"].to_numpy(dtype=int), found["place"].to_numpy(dtype=int)
        centroids[at] = found["total"].to_numpy(dtype=np.int64) // found["n"].to_numpy(dtype=np.int64)
    short = rotated(centroids, mean, axes, leading)

    def assign(batches):
        import pyarrow as pa

        for batch in batches:
            ids = batch.column("vec_id")
            for at, part, cluster, distance, _ in _assignments(batch, centroids, short):
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, len(part)), pa.array(cluster.astype(np.int32)), pa.array(distance)],
                    ["vec_id", "cluster", "distance"],
                )

    made = vectors.mapInArrow(assign, f"vec_id {kind}, cluster int, distance bigint")
    return Clusters(centroids, stored(made, "assigned"))


def with_totals(found: Clusters) -> DataFrame:
    """Every vector with the summed distances of its cluster and of all, and its centroid's sha256.

    A sum that does not fit a long is null. The table of clusters that is broadcast has k rows.
    """
    wide = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = {row[0]: int(row[1]) for row in found.assigned.groupBy("cluster").agg(wide).collect()}
    total = sum(sums.values())
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids.tolist()]
    rows = [(j, *(x if x < 1 << 63 else None for x in (sums[j], total)), names[j]) for j in sums]
    table = found.assigned.sparkSession.createDataFrame(
        rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    )
    return found.assigned.join(F.broadcast(table), "cluster")
