"""Centroid clustering in integers, with centroids filtered in PCA-rotated coordinates.

Vectors become integers once.  A rotation onto the principal axes of all vectors is fitted from sums that tasks
combine; each vector is stored with its ``LEAD`` leading rotated coordinates and the norm of the rest.  For a vector
and a centroid, the squared distance of the leading coordinates plus the squared difference of the two residual
norms never exceeds the true squared distance.  The centroid of the least bound is measured exactly, and only
centroids whose bound does not exceed that distance are measured too, in 64-bit integers, so the filter (which works
in floating point, with a slack far above its rounding error) never changes a result.

A round is one pass over the stored table; a task sends one row of sums a centroid.  Only the centroids reach the
driver: their number and length are parameters and do not grow with the input.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.llm.common import stored

DIM = 64
SCALE = 1024
CLUSTERS = 8
ROUNDS = 10
SEED = 3
LEAD = 8
# rounding of rotated coordinates is below 1e-13 of the norms; the bound is lowered by this much of their square
SLACK = 1e-9
STEP_ROWS = 1 << 14


def largest_component(dim: int) -> int:
    """Integers up to this size have squared distances, and sums of them over ``dim`` components, within 64 bits."""
    return min(math.isqrt((1 << 60) // dim), (1 << 31) - 1)


def _integers(column: pa.Array, dim: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column that are kept, and their integers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lengths == dim)
    if not len(rows):
        return rows, np.zeros((0, dim), np.int64)
    values = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), dim)
    scaled = np.floor(values * scale)  # a missing component has become NaN
    fits = (np.abs(scaled) <= largest_component(dim)).all(axis=1)
    return rows[fits], scaled[fits].astype(np.int64)


def _moments_task(dim: int, scale: int):
    """Sums of components and of their products over a task, one row for each component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, first, second = 0, np.zeros(dim), np.zeros((dim, dim))
        for batch in batches:
            x = _integers(batch.column("v"), dim, scale)[1].astype(np.float64)
            n, first, second = n + len(x), first + x.sum(axis=0), second + x.T @ x
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(dim, dtype=np.int32)), pa.array(np.full(dim, n)), pa.array(first), pa.array(list(second))], names=["i", "n", "first", "second"])

    return run


def principal_axes(rows: DataFrame, dim: int, scale: int) -> np.ndarray:
    """Orthonormal axes (as columns) of the vectors ``v``, by falling variance; the sums are combined by component."""
    sums = rows.select("v").mapInArrow(_moments_task(dim, scale), "i int, n long, first double, second array<double>")
    total = sums.groupBy("i").agg(F.sum("n").alias("n"), F.sum("first").alias("first"), F.array(*[F.sum(F.col("second")[j]) for j in range(dim)]).alias("second"))
    table = total.orderBy("i").collect()  # dim rows
    if not table:
        return np.eye(dim)
    mean = np.array([r["first"] for r in table]) / table[0]["n"]
    spread = np.array([r["second"] for r in table]) / table[0]["n"] - np.outer(mean, mean)
    return np.linalg.eigh((spread + spread.T) / 2)[1][:, ::-1]


def rotated(x: np.ndarray, axes: np.ndarray, lead: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading rotated coordinates, and the norm of the others."""
    turned = x.astype(np.float64) @ axes
    return turned[:, :lead], np.sqrt(np.square(turned[:, lead:]).sum(axis=1))


def _prepare_task(shared, dim: int, scale: int, lead: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes = shared.value
        for batch in batches:
            rows, x = _integers(batch.column("v"), dim, scale)
            head, rest = rotated(x, axes, lead)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(rows)), pa.array([r.tobytes() for r in x.astype(np.int32)], pa.binary()),
                 pa.array([r.tobytes() for r in head], pa.binary()), pa.array(rest, pa.float64())],
                names=["vec_id", "x", "head", "rest"])

    return run


def _matrix(column: pa.Array, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def nearest(x: np.ndarray, head: np.ndarray, rest: np.ndarray, centroids: np.ndarray, c_head: np.ndarray, c_rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each vector (ties: the smaller number), exact squared distances, and how many were measured.

    Bounds decide which centroids are measured; all decisions between measured ones are made in integers.
    """
    bound = np.square(rest[:, None] - c_rest[None, :])
    for j in range(head.shape[1]):
        bound += np.square(head[:, j, None] - c_head[None, :, j])
    norm = np.sqrt(np.square(head).sum(axis=1) + np.square(rest))
    c_norm = np.sqrt(np.square(c_head).sum(axis=1) + np.square(c_rest))
    bound -= SLACK * np.square(norm[:, None] + c_norm[None, :])
    best = bound.argmin(axis=1)
    least = np.square(x - centroids[best]).sum(axis=1)
    measured = len(x)
    open_ = bound <= least[:, None]
    open_[np.arange(len(x)), best] = False
    for c in range(len(centroids)):
        rows = np.flatnonzero(open_[:, c])
        rows = rows[bound[rows, c] <= least[rows]]  # the least distance may have fallen since
        if not len(rows):
            continue
        measured += len(rows)
        distance = np.square(x[rows] - centroids[c]).sum(axis=1)
        better = (distance < least[rows]) | ((distance == least[rows]) & (c < best[rows]))
        best[rows[better]], least[rows[better]] = c, distance[better]
    return best, least, measured


def _assigned(batch: pa.RecordBatch, plan) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray, int]]:
    centroids, c_head, c_rest = plan
    for at in range(0, batch.num_rows, STEP_ROWS):
        some = slice(at, min(at + STEP_ROWS, batch.num_rows))
        part = batch.slice(at, some.stop - at)
        x = _matrix(part.column("x"), np.int32, centroids.shape[1]).astype(np.int64)
        head = _matrix(part.column("head"), np.float64, c_head.shape[1])
        yield some, x, *nearest(x, head, part.column("rest").to_numpy(), centroids, c_head, c_rest)


def _sums_task(shared):
    """One row a centroid and task: number of vectors and sums of their components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dim = shared.value[0].shape
        count, sums = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in batches:
            for _, x, best, _, _ in _assigned(batch, shared.value):
                count += np.bincount(best, minlength=k)
                for c in np.unique(best):
                    sums[c] += x[best == c].sum(axis=0)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(count[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    return run


def _assign_task(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, _, best, least, measured in _assigned(batch, shared.value):
                ids = batch.column("vec_id").slice(some.start, some.stop - some.start)
                looked = np.zeros(len(best), np.int64)
                looked[:1] = measured
                yield pa.RecordBatch.from_arrays([ids, pa.array(best.astype(np.int32)), pa.array(least), pa.array(looked)], names=["vec_id", "cluster", "distance", "measured"])

    return run


def _plan(spark, centroids: np.ndarray, axes: np.ndarray, lead: int):
    return spark.sparkContext.broadcast((centroids, *rotated(centroids, axes, lead)))


def starting_centroids(points: DataFrame, k: int, seed: int, dim: int) -> np.ndarray:
    """The ``k`` vectors with the smallest hash of seed and id; equal hashes (repeated ids) by content, null ids last."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = points.select("x", key.alias("key")).orderBy(F.col("key").asc_nulls_last(), "x").limit(k).collect()
    return np.array([np.frombuffer(bytes(r["x"]), np.int32) for r in rows], np.int64).reshape(len(rows), dim)


def clustered(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = DIM, scale: int = SCALE, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, lead: int = LEAD,
) -> tuple[DataFrame, list[list[int]]]:
    """``(rows, centroids)``: ``vec_id, cluster, distance, measured`` of every kept vector, and the final centroids.

    A vector is kept if it has exactly ``dim`` components, none null or non-finite; components become
    ``floor(scale * x)``.  Integers beyond ``largest_component(dim)``, whose squared distances need not fit 64
    bits, count as non-finite.  Rows that repeat a vector or an id are vectors of their own; a null id takes part and comes last
    among the starting ones.  With fewer than ``k`` kept vectors there are as many centroids as vectors; an
    empty table gives an empty result.  A centroid without vectors stays where it is.  ``measured`` adds up to the
    number of exact distances of the last pass.  Other columns are never read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    lead = min(lead, dim)
    axes = principal_axes(rows, dim, scale)
    points = stored(rows.mapInArrow(_prepare_task(spark.sparkContext.broadcast(axes), dim, scale, lead), "vec_id long, x binary, head binary, rest double"), "cluster-points")
    centroids = starting_centroids(points, k, seed, dim)
    schema = "vec_id long, cluster int, distance long, measured long"
    if not len(centroids):
        return spark.createDataFrame([], schema), []
    for _ in range(rounds):
        sums = points.select("x", "head", "rest").mapInArrow(_sums_task(_plan(spark, centroids, axes, lead)), "cluster int, n long, sums array<long>")
        exact = [F.sum(F.col("sums")[j].cast("decimal(38,0)")) for j in range(dim)]
        moved = centroids.copy()
        for r in sums.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*exact).alias("sums")).collect():  # k rows
            moved[r["cluster"]] = [int(s) // r["n"] for s in r["sums"]]
        if (moved == centroids).all():  # a fixed point: the remaining rounds change nothing
            break
        centroids = moved
    return stored(points.select("vec_id", "x", "head", "rest").mapInArrow(_assign_task(_plan(spark, centroids, axes, lead)), schema), "cluster-rows"), centroids.tolist()


def cluster_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", **how) -> DataFrame:
    """One row per kept vector: ``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``.

    See ``clustered`` for what is kept and how odd rows count.  Inertias add up exactly; one that does not fit 64 bits is null.
    """
    rows, centroids = clustered(vectors, id_col, vector_col, **how)
    spark = vectors.sparkSession
    digests = [(c, hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids)]
    sums = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("part"))  # one row a centroid
    parts = {r["cluster"]: int(r["part"]) for r in sums.collect()}
    fits = lambda total: total if total < 1 << 63 else None
    table = [(c, fits(parts.get(c, 0)), fits(sum(parts.values())), digest) for c, digest in digests]
    of_cluster = spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.select("vec_id", "cluster", "distance").join(F.broadcast(of_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
