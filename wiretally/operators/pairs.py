"""Source-destination pairs: counts, scaled activity, top pairs and victims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiretally.operators.ranking import top_k
from wiretally.schema import TOP_PAIRS


def pair_counts(packets: DataFrame) -> DataFrame:
    """``(capture, src, dst, n)``."""
    return packets.groupBy("capture", "src", "dst").agg(F.count("*").alias("n"))


def pair_range(pairs: DataFrame) -> DataFrame:
    """``(capture, highest, lowest, spread)`` of the pair counts."""
    return pairs.groupBy("capture").agg(
        F.max("n").alias("highest"),
        F.min("n").alias("lowest"),
        (F.max("n") - F.min("n")).alias("spread"),
    )


def scaled(n: Column, highest: Column, spread: Column) -> Column:
    """0 for the busiest pair up to 100 for the quietest, rounded down.

    When every pair is equally busy each one is the busiest: 0.
    """
    whole = F.call_function("div", (highest - n) * 100, spread)
    return F.when(spread == 0, F.lit(0).cast("bigint")).otherwise(whole)


def scale_pairs(pairs: DataFrame, ranges: DataFrame) -> DataFrame:
    """Add ``value`` from the range of each pair's capture.

    The null-safe comparison puts no filter on either side, so that ``pairs``
    and a range computed from it keep sharing one aggregation.
    """
    same = F.col("p.capture").eqNullSafe(F.col("r.capture"))
    value = scaled(F.col("n"), F.col("highest"), F.col("spread"))
    return (
        pairs.alias("p")
        .join(ranges.alias("r"), same)
        .select("p.*", value.alias("value"))
    )


def top_pairs_of(pairs: DataFrame, k: int = TOP_PAIRS) -> DataFrame:
    """``(capture, rank, src, dst, n, value)``; the range covers all pairs, not just k."""
    top = top_k(pairs, k, ties=("src", "dst"))
    return scale_pairs(top, pair_range(pairs)).select(
        "capture", "rank", "src", "dst", "n", "value"
    )


def top_pairs(packets: DataFrame, k: int = TOP_PAIRS) -> DataFrame:
    return top_pairs_of(pair_counts(packets), k)


def victims(top: DataFrame, capture: str = "attack") -> DataFrame:
    """``(rank, dst, value)``: top pairs of one capture without their source.

    A destination repeats once per pair, as the ranking is one of pairs.
    """
    return top.where(F.col("capture") == capture).select("rank", "dst", "value")


def top_victims(packets: DataFrame, k: int = TOP_PAIRS, capture: str = "attack") -> DataFrame:
    attacked = packets.where(F.col("capture") == capture)
    return victims(top_pairs(attacked, k), capture)
