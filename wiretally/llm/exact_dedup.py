"""Exact duplicates by a heavy-hitter split.

A Misra-Gries sketch per task, merged in two steps, names digests that may be
frequent. Their exact winners are few, so they are broadcast and decide their
rows where these are read. All other digests have few rows each and go through
an ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiretally.llm.common import lower_ascii, staged

# Counters in a sketch. Any digest of more than 1 in 0.75 * TRACKED rows is found.
TRACKED = 1024
# Digests broadcast at most: the sketch's largest.
HEAVY = 512
# Sketches are merged in this many tasks before the last one.
MERGE_TASKS = 64


def exact_dedup(
    docs: DataFrame, tracked: int = TRACKED, heavy: int = HEAVY, name: str = "text"
) -> DataFrame:
    """One row per row of ``docs`` with the row of its text that stays.

    Returns ``doc_id, keep_id, group_size, kept, text_sha256``. Texts are equal
    if identical after lower-casing A-Z. Defined cases: a null text counts as
    empty; a null ``doc_id`` is below every number, so such a row stays only if
    its whole group has none; of repeated rows of one ``doc_id`` exactly one
    stays; an empty table gives no rows; other columns are not read.
    """
    digests = staged(
        docs.select(
            "doc_id",
            F.sha2(lower_ascii(F.coalesce(F.col(name), F.lit(""))), 256).alias("text_sha256"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "digests",
    )
    winners = F.broadcast(_winners(digests, tracked, heavy))
    head = digests.join(winners, "text_sha256")

    # Tasks send on one row of each text, and adaptive execution may split the join.
    rest = digests.join(winners, "text_sha256", "left_anti")
    decided = rest.groupBy("text_sha256").agg(
        F.max(F.struct("doc_id", "row")).alias("winner"), F.count("*").alias("group_size")
    )
    tail = rest.join(decided.hint("merge"), "text_sha256")
    return head.unionByName(tail).select(
        "doc_id",
        F.col("winner.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("winner.row")).alias("kept"),
        "text_sha256",
    )


def _winners(digests: DataFrame, tracked: int, heavy: int) -> DataFrame:
    """At most ``heavy`` rows: exact group size and winner of the frequent digests."""
    sketches = digests.groupBy((F.spark_partition_id() % MERGE_TASKS).alias("part")).agg(
        F.expr(f"approx_top_k_accumulate(text_sha256, {tracked})").alias("sketch")
    )
    frequent = (
        # One group, not none: a task without sketches then adds nothing.
        sketches.groupBy(F.lit("all")).agg(F.expr(f"approx_top_k_combine(sketch, {tracked})").alias("sketch"))
        .select(F.explode(F.expr(f"approx_top_k_estimate(sketch, {heavy})")).alias("f"))
        .select(F.col("f.item").alias("text_sha256"))
    )
    counted = (
        digests.join(F.broadcast(frequent), "text_sha256", "left_semi")
        .groupBy("text_sha256")
        .agg(
            F.max(F.struct("doc_id", "row")).alias("winner"),
            F.count("*").alias("group_size"),
        )
    )
    return staged(counted.where("group_size > 1"), "winners")
