"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from wiretally.llm import (
    bpe,
    centroids,
    exact_dedup,
    language_id,
    license_scan,
    line_dedup,
    mixing,
    periodic_runs,
    personal_data,
    quality,
    secret_scan,
    simhash,
    topk,
)
from wiretally.llm.common import table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")

Query = Callable[[SparkSession, str], DataFrame]


def _on_documents(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, "documents"))


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_inner_products(table(spark, sf_dir, "embeddings"))


def _line_dedup(docs: DataFrame) -> DataFrame:
    return line_dedup.drop_repeated_runs(docs.select("doc_id", "text"))


QUERIES: dict[str, Query] = {
    "op1_language_id": _on_documents(language_id.language_id),
    "op2_bpe": _on_documents(lambda docs: bpe.token_digests(docs, VOCABULARY)),
    "op3_topk": _topk,
    "op4_line_dedup": _on_documents(_line_dedup),
    "op5_simhash": _on_documents(simhash.simhash_components),
    "op6_mixing": _on_documents(mixing.mixing_counts),
    "op7_quality": _quality,
    "op8_license_scan": _on_documents(license_scan.license_paragraphs),
    "op9_secret_scan": _on_documents(secret_scan.secret_spans),
    "op10_exact_dedup": _on_documents(exact_dedup.exact_dedup),
    "op11_personal_data": _on_documents(personal_data.personal_spans),
    "op12_centroids": lambda spark, sf_dir: centroids.centroid_clusters(table(spark, sf_dir, "embeddings")),
    "op13_periodic_runs": _on_documents(
        lambda docs: periodic_runs.periodic_runs(docs, take=periodic_runs.rearranged)
    ),
}

# One round of op12: the nearest centroid of each vector, and the rounded means of the clusters.
_ASSIGNED = """
        {a} AS (
            SELECT k.row, k.vec_id, c.n AS cluster, c.v AS centroid,
                   (list_dot_product(k.v, k.v) - 2 * list_dot_product(k.v, c.v)
                    + list_dot_product(c.v, c.v))::BIGINT AS distance
            FROM kept k CROSS JOIN {c} c
            QUALIFY row_number() OVER (PARTITION BY k.row ORDER BY distance, c.n) = 1
        )"""
_MOVED = """
        {c}s AS (
            SELECT a.cluster, x.i, sum(x.e::BIGINT)::HUGEINT AS s, count(*) AS m
            FROM {a} a JOIN parts x ON a.row = x.row
            GROUP BY a.cluster, x.i
        ), {c} AS (
            SELECT b.n, coalesce(m.v, b.v) AS v
            FROM {before} b LEFT JOIN (
                SELECT cluster, list(((s - ((s % m) + m) % m) // m)::DOUBLE ORDER BY i) AS v
                FROM {c}s GROUP BY cluster
            ) m ON b.n = m.cluster
        )"""
_ROUNDS = ",".join(
    _ASSIGNED.format(a=f"a{i}", c=f"c{i}") + ("," + _MOVED.format(a=f"a{i}", c=f"c{i + 1}", before=f"c{i}") if i < 3 else "")
    for i in range(4)
)

ORACLE: dict[str, str] = {
    "op3_topk": """
        WITH usable AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   list_dot_product(q.v, c.v)::BIGINT AS score
            FROM usable q JOIN usable c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
        )
        SELECT query_id,
               (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank,
               vec_id, score
        FROM scored
        QUALIFY rank <= 10
    """,
    "op6_mixing": r"""
        WITH sized AS (
            SELECT doc_id, source,
                   len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                   md5('42:' || coalesce(doc_id::VARCHAR, '')) AS key
            FROM documents
        ), sources AS (
            SELECT source, sum(size)::BIGINT AS source_size,
                   list_extract([3, 1, 2], ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER) AS weight
            FROM sized GROUP BY source
        ), ordered AS (
            SELECT *, 2.0::DOUBLE * source_size AS cap,
                   coalesce(sum(2.0::DOUBLE * source_size) OVER before, 0) AS cap_before,
                   sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS weight_left,
                   1.5::DOUBLE * sum(source_size) OVER () AS budget
            FROM sources
            WINDOW before AS (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST
                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), leveled AS (
            SELECT *, (SELECT (o.budget - o.cap_before) / o.weight_left FROM ordered o
                       WHERE o.cap > o.weight * ((o.budget - o.cap_before) / o.weight_left)
                       ORDER BY o.cap_before LIMIT 1) AS level
            FROM ordered
        ), targets AS (
            SELECT source, source_size, least(cap, weight * coalesce(level, 0))::DOUBLE AS target
            FROM leveled
        ), parted AS (
            SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole
            FROM targets
        ), keys AS (
            SELECT s.source, s.key, sum(s.size) AS words FROM sized s GROUP BY s.source, s.key
        ), running AS (
            SELECT k.*, p.target - p.whole * p.source_size AS rest,
                   sum(words) OVER (PARTITION BY k.source ORDER BY key) AS upto
            FROM keys k JOIN parted p ON k.source IS NOT DISTINCT FROM p.source
        ), cut AS (
            SELECT source, max(rest) - coalesce(max(upto) FILTER (upto <= rest AND rest > 0), 0) AS gap,
                   coalesce(max(key) FILTER (upto <= rest AND rest > 0), '') AS cutoff, max(rest) AS rest
            FROM running GROUP BY source
        ), extras AS (
            SELECT r.source, max({'words': r.words, 'key': r.key}).key AS extra
            FROM running r JOIN cut c ON r.source IS NOT DISTINCT FROM c.source
            WHERE r.key > c.cutoff AND r.words <= c.gap AND c.rest > 0
            GROUP BY r.source
        )
        SELECT s.doc_id, s.size, p.source_size, p.target,
               (s.size * (p.whole + CASE WHEN s.key <= c.cutoff OR s.key = x.extra THEN 1 ELSE 0 END))::BIGINT AS taken
        FROM sized s
        JOIN parted p ON s.source IS NOT DISTINCT FROM p.source
        JOIN cut c ON s.source IS NOT DISTINCT FROM c.source
        LEFT JOIN extras x ON s.source IS NOT DISTINCT FROM x.source
    """,
    "op10_exact_dedup": """
        WITH digests AS (
            SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                            'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
            FROM documents
        )
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM digests
        WINDOW w AS (PARTITION BY text_sha256)
    """,
    "op12_centroids": f"""
        WITH usable AS (
            SELECT vec_id, embedding FROM embeddings
            WHERE len(embedding) = 64
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), kept AS (
            SELECT row_number() OVER () AS row, vec_id,
                   list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v
            FROM usable
        ), parts AS (
            SELECT row, unnest(v) AS e, generate_subscripts(v, 1) AS i FROM kept
        ), c0 AS (
            SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id::VARCHAR)) - 1 AS n, v
            FROM kept QUALIFY n < 16
        ),{_ROUNDS}
        SELECT vec_id, cluster::INTEGER AS cluster, distance,
               sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia,
               sum(distance) OVER ()::BIGINT AS inertia,
               sha256(array_to_string(list_transform(centroid, lambda x: x::BIGINT::VARCHAR), ',')) AS centroid_sha256
        FROM a3
    """,
}
