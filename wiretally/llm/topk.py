"""Exact top-k inner products over norm-sorted blocks.

Vectors are sorted by length and cut into blocks. The longest few give every
query a first bound on its k-th score; by Cauchy-Schwarz a query then needs only
the blocks whose longest vector can reach it. Within a pair of blocks, vectors
are rotated by the singular vectors of a sample, partial sums run over the
leading directions first, and a residual bound on the rest drops candidates.
Survivors get their exact integer score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wiretally.llm.common import bounded_sample, staged

K = 10
EVERY = 100
SCALE = 1024
# Vectors of a block of candidates and of one of queries, and of the broadcast head.
BLOCK = 4096
QUERY_BLOCK = 512
HEAD = 2048
# Rows of the sample that the rotation is fitted on.
SAMPLE = 4096
# Shares of the dimensions after which candidates are dropped.
STEPS = (0.25, 0.5, 0.75)
# Largest product of lengths whose dot products are exact in doubles.
EXACT = 2.0**52
LOWEST = np.iinfo(np.int64).min


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """``vec_id, v, norm`` of the usable rows: floor(1024 x) of each component, and their length."""
    finite = F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    )
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE))
    return (
        embeddings.select("vec_id", "embedding")
        .where(F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False)))
        .select("vec_id", whole.alias("v"))
        .withColumn(
            "norm",
            F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))),
        )
    )


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column; shorter vectors continue with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    if len(lengths) and (lengths == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(lengths), dims), np.int64)
    at = np.r_[0, np.cumsum(lengths)]
    for i in range(len(lengths)):
        out[i, : lengths[i]] = flat[at[i] : at[i + 1]]
    return out


def _packed(rows: DataFrame, dims: int, size: int, name: str) -> DataFrame:
    """Blocks of up to ``size`` rows in the order of each partition, as arrays of bytes."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(ids, nulls, bounds, vectors):
            length = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))
            # How long a vector must be for any row's product with it to reach its bound.
            needs = np.where(length > 0, bounds / np.maximum(length, 1), -np.inf).min()
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([x.tobytes()]) for x in (ids, nulls, bounds, vectors)
                ]
                + [pa.array([float(length.max())]), pa.array([float(needs)])],
                ["ids", "nulls", "bounds", "vectors", "longest", "needs"],
            )

        held = None
        for batch in batches:
            part = [
                batch.column("vec_id").fill_null(0).to_numpy(),
                batch.column("vec_id").is_null().to_numpy(zero_copy_only=False),
                batch.column("bound").to_numpy(),
                _matrix(batch.column("v"), dims),
            ]
            held = part if held is None else [np.concatenate(x) for x in zip(held, part, strict=True)]
            while len(held[0]) >= size:
                yield block(*(x[:size] for x in held))
                held = [x[size:] for x in held]
        if held is not None and len(held[0]):
            yield block(*held)

    packed = rows.select("vec_id", "v", "bound").mapInArrow(
        of_batches, "ids binary, nulls binary, bounds binary, vectors binary, longest double, needs double"
    )
    return staged(packed.withColumn("lane", F.spark_partition_id()), name)


def _exact(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Row-wise integer inner products of equally many rows."""
    return np.einsum("ij,ij->i", queries, candidates)


def _head_bounds(queries: DataFrame, head: np.ndarray, head_ids: np.ndarray, dims: int, k: int) -> DataFrame:
    """``queries`` with ``bound``: the k-th score among the head, or the lowest number."""
    shared = queries.sparkSession.sparkContext.broadcast((head, head_ids))

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, head_ids = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, QUERY_BLOCK):
                part = batch.slice(at, QUERY_BLOCK)
                ids, v = part.column("vec_id").to_numpy(), _matrix(part.column("v"), dims)
                bound = np.full(len(ids), LOWEST, np.int64)
                if len(head) > k:
                    scores = _scores(v, head)
                    scores[ids[:, None] == head_ids[None, :]] = LOWEST
                    bound = np.partition(scores, len(head) - k, axis=1)[:, len(head) - k]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(bound)], [*part.schema.names, "bound"]
                )

    return queries.mapInArrow(of_batches, "vec_id bigint, v array<bigint>, norm double, bound bigint")


def _scores(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """All integer inner products; through doubles where these are exact."""
    q, c = queries.astype(np.float64), candidates.astype(np.float64)
    most = np.sqrt((q * q).sum(1)).max(initial=0) * np.sqrt((c * c).sum(1)).max(initial=0)
    if most < EXACT:
        return (q @ c.T).astype(np.int64)
    return queries @ candidates.T


def block_top(
    q_ids, q, bounds, c_ids, c_nulls, c, rotation: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query rows, candidate rows and scores that may be among the k best of their query.

    Only scores of at least ``bounds`` matter; each query keeps at most ``k``.
    """
    qr, cr = q @ rotation, c @ rotation
    dims = rotation.shape[1]
    cuts = sorted({max(1, int(dims * s)) for s in STEPS} - {dims})
    alive = np.arange(len(c))
    partial = np.zeros((len(q), len(c)))
    q2, c2 = (qr * qr).sum(1), (cr * cr).sum(1)
    # Rounding of the rotated sums stays far below this.
    slack = 1e-9 * np.sqrt(q2.max(initial=0) * c2.max(initial=0)) + 1
    possible = None
    at = 0
    for cut in cuts:
        partial += qr[:, at:cut] @ cr[alive, at:cut].T
        q2 = np.maximum(q2 - (qr[:, at:cut] ** 2).sum(1), 0)
        c2 = np.maximum(c2 - (cr[alive, at:cut] ** 2).sum(1), 0)
        most = partial + np.sqrt(q2)[:, None] * np.sqrt(c2)[None, :]
        possible = most >= bounds[:, None] - slack
        some = possible.any(0)
        alive, partial, c2, possible = alive[some], partial[:, some], c2[some], possible[:, some]
        at = cut
        if not len(alive):
            break
    if possible is None:
        possible = np.ones((len(q), len(alive)), bool)
    rows, columns = np.nonzero(possible)
    if len(rows) > possible.size // 8:
        scores = _scores(q, c[alive])[rows, columns]
    else:
        steps = range(0, len(rows), 1 << 16)
        scores = np.concatenate(
            [_exact(q[rows[s : s + (1 << 16)]], c[alive[columns[s : s + (1 << 16)]]]) for s in steps]
            or [np.zeros(0, np.int64)]
        )
    columns = alive[columns]
    ok = (scores >= bounds[rows]) & ((q_ids[rows] != c_ids[columns]) | c_nulls[columns])
    rows, columns, scores = rows[ok], columns[ok], scores[ok]
    order = np.lexsort((c_ids[columns], c_nulls[columns], -scores, rows))
    rows, columns, scores = rows[order], columns[order], scores[order]
    first = np.searchsorted(rows, rows)
    best = np.arange(len(rows)) - first < k
    return rows[best], columns[best], scores[best]


def _pair_top(pairs: DataFrame, rotation: np.ndarray, dims: int, k: int) -> DataFrame:
    shared = pairs.sparkSession.sparkContext.broadcast(rotation)

    def unpack(x: pa.RecordBatch, row: int, prefix: str):
        def array(name, kind):
            return np.frombuffer(x.column(prefix + name)[row].as_py(), kind)

        ids = array("ids", np.int64)
        return ids, array("nulls", bool), array("bounds", np.int64), array("vectors", np.int64).reshape(len(ids), dims)

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                q_ids, _, bounds, q = unpack(batch, row, "q_")
                c_ids, c_nulls, _, c = unpack(batch, row, "")
                rows, columns, scores = block_top(
                    q_ids, q, bounds, c_ids, c_nulls, c, shared.value, k
                )
                ids = pa.array(c_ids[columns], mask=c_nulls[columns])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q_ids[rows]), ids, pa.array(scores)], ["query_id", "vec_id", "score"]
                )

    return pairs.mapInArrow(of_batches, "query_id bigint, vec_id bigint, score bigint")


def top_inner_products(embeddings: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` largest integer inner products.

    Queries are the vectors whose id is divisible by ``every``; candidates are
    all vectors of another id. Defined cases: vectors that are null or hold a
    null or non-finite component take no part; shorter vectors count as
    continued with zeros; ties go to the smaller id, null last; a vector with a
    null id is a candidate only; rows repeated are candidates each; a query id
    that occurs more than once is one query per row, ranked together; fewer than
    ``k`` candidates give all; an empty table gives no rows. Scores must fit in
    64 bits.
    """
    vectors = staged(integer_vectors(embeddings), "vectors")
    dims = vectors.agg(F.max(F.size("v"))).head()[0] or 1
    blocks = _packed(
        vectors.withColumn("bound", F.lit(0).cast("bigint"))
        .repartitionByRange(F.desc("norm"), F.asc("vec_id"))
        .sortWithinPartitions(F.desc("norm"), F.asc("vec_id")),
        dims, BLOCK, "blocks",
    )

    # The first block holds the longest vectors.
    longest = blocks.orderBy("lane", F.desc("longest")).limit(1).collect()
    head_ids, head = np.zeros(0, np.int64), np.zeros((0, dims), np.int64)
    if longest:
        known = ~np.frombuffer(longest[0]["nulls"], bool)[:HEAD]
        head_ids = np.frombuffer(longest[0]["ids"], np.int64)[:HEAD][known]
        head = np.frombuffer(longest[0]["vectors"], np.int64).reshape(-1, dims)[:HEAD][known]
    some = bounded_sample(vectors.select("vec_id", "v"), SAMPLE, EVERY, "vec_id").collect()
    sample = np.array([list(r["v"]) + [0] * (dims - len(r["v"])) for r in some], np.float64)
    sample = sample.reshape(len(some), dims)
    rotation = np.linalg.svd(sample.T @ sample)[2].T

    queries = vectors.where(F.col("vec_id") % every == 0)
    bounded = _head_bounds(queries, head, head_ids, dims, k).withColumn(
        "needs",
        F.when(F.col("norm") > 0, F.col("bound") / F.col("norm")).otherwise(float("-inf")),
    )
    # Queries of similar needs share a block.
    query_blocks = _packed(
        bounded.repartitionByRange("needs", "vec_id").sortWithinPartitions("needs", "vec_id"),
        dims, QUERY_BLOCK, "queries",
    )
    return _ranked(_pair_top(_pairs(query_blocks, blocks), rotation, dims, k), k)


def _reaching(query_blocks: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each block of queries once per lane that holds a vector long enough for one of them.

    One number per lane goes to the driver; blocks are copied for these lanes only.
    """
    longest = blocks.groupBy("lane").agg(F.max("longest").alias("longest")).collect() or [(0, 0.0)]
    lanes, lengths = F.lit([r[0] for r in longest]), F.lit([r[1] for r in longest])
    reached = F.filter(lanes, lambda _, i: _reach(F.get(lengths, i), F.col("needs")))
    return query_blocks.select(
        F.explode(reached).alias("lane"),
        *[F.col(c).alias(f"q_{c}") for c in ("ids", "nulls", "bounds", "vectors", "needs")],
    )


def _reach(longest: Column, needs: Column) -> Column:
    return longest * (1 + 1e-9) + 1e-9 >= needs


def _pairs(query_blocks: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each block of queries beside each block of candidates that is long enough for one of them."""
    return (
        _reaching(query_blocks, blocks)
        .join(blocks.drop("needs"), "lane")
        .where(_reach(F.col("longest"), F.col("q_needs")))
        .drop("lane", "q_needs", "longest")
    )


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
