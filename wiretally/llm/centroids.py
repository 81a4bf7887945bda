"""Centroid clustering with assignment by Orchard search.

Each centroid has the list of all others, nearest first. A vector starts at one
centroid and walks its list; a centroid found nearer takes over and its list is
walked from the start. Those seen before are passed over, and the walk stops at a
neighbour farther from the centroid in hand than twice the vector's distance: by
the triangle inequality neither it nor any after it can be as near. All numbers
are integers, so distances, ties and means are exact.

A round reads the vectors once. Tasks send on one row of sums per cluster; only
the centroids themselves reach the driver.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

DIMENSIONS = 64
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
SEED = 1
# Vectors that walk at a time.
STEP = 8192


def kept_vectors(batch: pa.RecordBatch, dims: int, scale: int) -> tuple[pa.Array, np.ndarray]:
    """Ids and integer vectors of the rows with ``dims`` components, all of them finite."""
    column = batch.column("embedding")
    sized = pc.fill_null(pc.equal(pc.list_value_length(column), dims), False)
    rows = batch.filter(sized)
    flat = rows.column("embedding").flatten().cast(pa.float64())
    values = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dims)
    finite = np.isfinite(values).all(axis=1)
    ids = rows.column("vec_id").filter(pa.array(finite))
    return ids, np.floor(values[finite] * scale).astype(np.int64)


def _key(vec_id: int | None, seed: int) -> str:
    return hashlib.sha256(f"{seed}:{'' if vec_id is None else vec_id}".encode()).hexdigest()


def first_centroids(
    embeddings: DataFrame, clusters: int, seed: int, dims: int, scale: int
) -> np.ndarray:
    """The kept vectors whose ids have the smallest hashes, in order; ties by components."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[str, list[int]]] = []
        for batch in batches:
            ids, vectors = kept_vectors(batch, dims, scale)
            keys = [_key(i, seed) for i in ids.to_pylist()]
            last = max(heapq.nsmallest(clusters, keys), default="")
            near = [r for r, key in enumerate(keys) if key <= last]
            near = heapq.nsmallest(clusters, near, key=lambda r: (keys[r], vectors[r].tolist()))
            best = sorted([*best, *((keys[r], vectors[r].tolist()) for r in near)])[:clusters]
        if best:
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in best]), pa.array([v for _, v in best], pa.list_(pa.int64()))],
                ["key", "v"],
            )

    rows = (
        embeddings.select("vec_id", "embedding")
        .mapInArrow(of_batches, "key string, v array<bigint>")
        .orderBy("key", "v")
        .limit(clusters)
        .collect()
    )
    return np.array([r["v"] for r in rows], np.int64).reshape(len(rows), dims)


def neighbour_lists(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each centroid the others by distance, ties by number, and their squared distances."""
    k = len(centroids)
    apart = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)
    others = np.array([[j for j in range(k) if j != i] for i in range(k)], np.int64).reshape(k, k - 1)
    order = np.argsort(np.take_along_axis(apart, others, axis=1), axis=1, kind="stable")
    lists = np.take_along_axis(others, order, axis=1)
    return lists, np.take_along_axis(apart, lists, axis=1)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid (ties: the smaller number), squared distance, and distances worked out."""
    k, n = len(centroids), len(vectors)
    lists, apart = neighbour_lists(centroids)

    def squared(rows: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        difference = vectors[rows] - centroids[numbers]
        return np.einsum("ij,ij->i", difference, difference)

    at = np.zeros(n, np.int64)
    distance = squared(np.arange(n), at)
    seen = np.zeros((n, k), bool)
    seen[:, 0] = True
    place = np.zeros(n, np.int64)
    walking, tested = np.arange(n if k > 1 else 0), n
    while len(walking):
        here, p = at[walking], place[walking]
        # Squares on both sides: beyond twice the distance is beyond four times its square.
        within = apart[here, p] <= 4 * distance[walking]
        walking, here, p = walking[within], here[within], p[within]
        neighbour = lists[here, p]
        place[walking] += 1
        fresh = ~seen[walking, neighbour]
        rows, numbers = walking[fresh], neighbour[fresh]
        seen[rows, numbers] = True
        found = squared(rows, numbers)
        tested += len(rows)
        nearer = (found < distance[rows]) | ((found == distance[rows]) & (numbers < at[rows]))
        rows, numbers = rows[nearer], numbers[nearer]
        at[rows], distance[rows], place[rows] = numbers, found[nearer], 0
        walking = walking[place[walking] < k - 1]
    return at, distance, tested


def _partial_sums(embeddings: DataFrame, centroids: np.ndarray, dims: int, scale: int) -> DataFrame:
    """``cluster, n, sums``: one row of each task and cluster with members."""
    k = len(centroids)

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            _, vectors = kept_vectors(batch, dims, scale)
            for start in range(0, len(vectors), STEP):
                part = vectors[start : start + STEP]
                at, _, _ = nearest(part, centroids)
                n += np.bincount(at, minlength=k)
                np.add.at(sums, at, part)
        held = np.flatnonzero(n)
        if len(held):
            yield pa.RecordBatch.from_arrays(
                [pa.array(held), pa.array(n[held]), pa.array(sums[held].tolist(), pa.list_(pa.int64()))],
                ["cluster", "n", "sums"],
            )

    return embeddings.select("vec_id", "embedding").mapInArrow(
        of_batches, "cluster bigint, n bigint, sums array<bigint>"
    )


def moved(embeddings: DataFrame, centroids: np.ndarray, dims: int, scale: int) -> np.ndarray:
    """The centroids' members' means, rounded down; a centroid without members stays."""
    whole = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dims)]
    totals = _partial_sums(embeddings, centroids, dims, scale).groupBy("cluster").agg(F.sum("n").alias("n"), *whole)
    out = centroids.copy()
    for row in totals.collect():
        # Whole numbers of any size divide exactly.
        out[row["cluster"]] = [int(row[f"s{i}"]) // row["n"] for i in range(dims)]
    return out


def _assigned(embeddings: DataFrame, centroids: np.ndarray, dims: int, scale: int, kind: DataType) -> DataFrame:
    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = kept_vectors(batch, dims, scale)
            for start in range(0, len(vectors), STEP):
                at, distance, _ = nearest(vectors[start : start + STEP], centroids)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(start, STEP), pa.array(at, pa.int32()), pa.array(distance)],
                    ["vec_id", "cluster", "distance"],
                )

    return embeddings.select("vec_id", "embedding").mapInArrow(
        of_batches, f"vec_id {kind.simpleString()}, cluster int, distance bigint"
    )


def _of_cluster(values: list, kind: str) -> Column:
    """A constant of each cluster; there are as many as clusters."""
    return F.array(*[F.lit(v).cast(kind) for v in values])[F.col("cluster")]


def centroid_clusters(
    embeddings: DataFrame,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    seed: int = SEED,
    dims: int = DIMENSIONS,
    scale: int = SCALE,
) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of each kept vector.

    A vector is kept if it has ``dims`` components, none null, infinite or not a
    number; its components become floor(scale * x). ``distance`` is the squared
    distance to the centroid in the end, the inertias its sums. Defined cases:
    other vectors are left out; a null id hashes as empty text; vectors of one
    id are ordered by their components where they would be centroids; repeated
    rows count each; equal centroids keep their numbers, and the smaller one gets
    the members; fewer vectors than ``clusters`` are one centroid each; an empty
    table gives no rows; other columns are not read. Squared distances must
    fit in 60 bits.
    """
    centroids = first_centroids(embeddings, clusters, seed, dims, scale)
    kind = embeddings.schema["vec_id"].dataType
    if not len(centroids):
        columns = f"vec_id {kind.simpleString()}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
        return embeddings.sparkSession.createDataFrame([], columns)
    for _ in range(rounds):
        centroids = moved(embeddings, centroids, dims, scale)
    assigned = _assigned(embeddings, centroids, dims, scale, kind)
    sums = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    return assigned.select(
        "vec_id",
        "cluster",
        "distance",
        _of_cluster([sums.get(c, 0) for c in range(len(centroids))], "bigint").alias("cluster_inertia"),
        F.lit(sum(sums.values())).cast("bigint").alias("inertia"),
        _of_cluster(digests, "string").alias("centroid_sha256"),
    )
