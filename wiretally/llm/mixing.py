"""Mixing sources to target weights by capped water-filling.

Sources share a budget of words by weight. A source whose share exceeds its
most epochs is clamped, and the excess goes to the others by weight until none
is above. Whole epochs repeat every document; the rest of a target is a seeded
choice of documents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wiretally.llm.common import WORD, staged

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_EPOCHS = 2
SEED = 42
# Hex digits of a document's key that make its bucket: 4096 buckets a source.
BUCKET_DIGITS = 3


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    """``docs`` with its size in words and a seeded key that orders its source."""
    number = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return docs.select(
        F.struct("*").alias("doc"),
        "doc_id",
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), number)).alias("key"),
    )


def weighted_sources(sizes: DataFrame, weights: Sequence[int]) -> DataFrame:
    """``source, source_size, weight``; weights repeat along the sources in code point order.

    ``sizes`` has one row per source. Sources are sorted in ranges; only the
    number of sources in each range is summed up along them.
    """
    placed = staged(
        sizes.orderBy(F.col("source").asc_nulls_last()).withColumn(
            "place", F.monotonically_increasing_id()
        ),
        "sources",
    ).select("*", F.shiftright("place", 33).alias("part"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("part").agg(F.count("*").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start")
    )
    index = F.col("start") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    cycle = F.array(*[F.lit(w) for w in weights])
    return placed.join(starts, "part").select(
        "source",
        "source_size",
        F.element_at(cycle, (index % len(weights) + 1).cast("int")).alias("weight"),
    )


def fill(sources: DataFrame, share: float, most: float) -> DataFrame:
    """``sources`` with its ``target`` in words.

    Each round is one sum over the sources; the driver sees two numbers of it.
    """
    cap, weight = F.col("source_size") * most, F.col("weight")
    budget = share * (sources.agg(F.sum("source_size")).head()[0] or 0)
    level, clamped = 0.0, -1
    while True:
        full = cap <= weight * level
        done, capped, open_weight = sources.agg(
            F.count_if(full), F.sum(F.when(full, cap)), F.sum(F.when(~full, weight))
        ).head()
        if done == clamped or not open_weight:
            break
        level, clamped = (budget - (capped or 0.0)) / open_weight, done
    # Without an open source every target is its cap.
    target = F.least(cap, weight * level) if open_weight else cap
    return sources.withColumn("target", target.cast("double"))


def mixing_decisions(
    sized: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST_EPOCHS,
) -> DataFrame:
    """One row per source: ``source, source_size, target, whole, cutoff, extra``.

    Documents whose key is at most ``cutoff``, or is ``extra``, are taken once
    more than ``whole``. ``sized`` has ``source, size, key``.
    """
    bucket = F.substring("key", 1, BUCKET_DIGITS)
    buckets = staged(
        sized.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words")),
        "buckets",
    )
    sizes = buckets.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = staged(fill(weighted_sources(sizes, weights), share, most), "targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
    targets = targets.withColumn("whole", F.coalesce(whole, F.lit(0)).cast("long")).withColumn(
        "rest", F.col("target") - F.col("whole") * F.col("source_size")
    )

    def from_targets(rows: DataFrame) -> DataFrame:
        t = targets.select(F.col("source").alias("t_source"), "rest")
        return rows.join(t, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")

    along = Window.partitionBy("source").orderBy("bucket")
    crossing = (
        from_targets(buckets)
        .withColumn("before", F.sum("words").over(along) - F.col("words"))
        .where("before < rest and rest <= before + words")
        .select(F.col("source").alias("c_source"), "bucket", "before", "rest")
    )
    # Only the bucket in which a source's rest ends is ordered document by document.
    keys = (
        sized.join(
            crossing,
            F.col("source").eqNullSafe(F.col("c_source")) & (bucket == F.col("bucket")),
        )
        .groupBy("source", "bucket", "before", "rest", "key")
        .agg(F.sum("size").alias("words"))
    )
    upto = F.col("before") + F.sum("words").over(Window.partitionBy("source").orderBy("key"))
    cutoffs = (
        keys.withColumn("upto", upto)
        .withColumn("takes", F.col("upto") <= F.col("rest"))
        .groupBy("source")
        .agg(
            F.coalesce(F.max(F.when(F.col("takes"), F.col("key"))), F.max("bucket")).alias("cutoff"),
            (
                F.max("rest") - F.coalesce(F.max(F.when(F.col("takes"), F.col("upto"))), F.max("before"))
            ).alias("gap"),
        )
        .select(F.col("source").alias("c_source"), "cutoff", "gap")
    )
    cutoffs = staged(cutoffs, "cutoffs")
    # The largest later document that still fits brings the sum near its target.
    extras = (
        sized.join(
            cutoffs,
            F.col("source").eqNullSafe(F.col("c_source")) & (F.col("key") > F.col("cutoff")),
        )
        .groupBy("source", "gap", "key")
        .agg(F.sum("size").alias("words"))
        .where("words <= gap")
        .groupBy("source")
        .agg(F.max(F.struct("words", "key"))["key"].alias("extra"))
        .select(F.col("source").alias("x_source"), "extra")
    )
    decisions = (
        targets.join(cutoffs, F.col("source").eqNullSafe(F.col("c_source")), "left")
        .join(extras, F.col("source").eqNullSafe(F.col("x_source")), "left")
        .select(
            "source",
            "source_size",
            "target",
            "whole",
            F.coalesce("cutoff", F.lit("")).alias("cutoff"),
            F.coalesce("extra", F.lit("")).alias("extra"),
        )
    )
    return staged(decisions, "decisions")


def _copies(sized: DataFrame, decisions: DataFrame) -> DataFrame:
    d = decisions.withColumnRenamed("source", "d_source")
    more = (F.col("key") <= F.col("cutoff")) | (F.col("key") == F.col("extra"))
    return sized.join(d, F.col("source").eqNullSafe(F.col("d_source")), "left").withColumn(
        "copies", F.col("whole") + more.cast("long")
    )


def mixing_counts(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row of ``docs``.

    Defined cases: a null text has size 0; a null source is a source of its
    own, after all others; sources of equal name are one; rows of one
    ``doc_id`` share a key and are taken alike; a corpus without words has
    targets of 0; an empty table gives no rows; other columns are not read.
    """
    narrow = docs.select("doc_id", "source", "text")
    sized = staged(_sized(narrow, seed).drop("doc"), "sized")
    return _copies(sized, mixing_decisions(sized)).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


def mix_sources(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; cases as above."""
    sized = staged(_sized(docs.select("doc_id", "source", "text"), seed).drop("doc"), "sized")
    rows = _copies(_sized(docs, seed), mixing_decisions(sized))
    return rows.where("copies > 0").select(
        "doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    ).select("doc.*")
