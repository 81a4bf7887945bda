"""Location of IPv6 addresses: the longest network that holds each one.

Networks are cut into aligned pieces of fixed sizes, at most 8 or 128 each, and a
piece is kept once. Pieces and addresses are sorted together, and the last piece
of each size to start at or before an address is the only one of that size that
can hold it.

Unlike a /16 of IPv4, no prefix bounds how many addresses share it, so rows are
not grouped by one: they are dealt to lanes by ranges of the sorted order, which
splits a prefix that holds a third of all addresses like any other. What is open
where a lane begins, at most one piece of each size, is carried over from the
lanes before it: one row per lane.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wiretally.functions.columns import ipv6_halves
from wiretally.sinks import shared_folder, stage

# Sizes of pieces; allocations are dense up to /64 and rare beyond.
LEVELS = (*range(16, 65, 4), *range(72, 129, 8))
_ATTRIBUTES = ("country", "city", "latitude", "longitude")
# Signed order of numbers with the first bit turned is the order of the unsigned ones.
_TURN = -(2**63)


def network_pieces(networks: DataFrame) -> DataFrame:
    """``(level, hi, lo, hit)``: each aligned piece once, with its most specific network.

    The longest prefix wins, then the attribute values, so the choice never
    depends on row order.
    """
    length = F.col("prefix_len")
    level = F.element_at(F.filter(F.array(*map(F.lit, LEVELS)), lambda n: n >= length), 1)
    hit = F.struct("prefix_len", *_ATTRIBUTES)
    # Copies of a network collapse before it is cut up.
    distinct = networks.groupBy("hi", "lo", "prefix_len").agg(F.max(hit).alias("hit"))
    return (
        distinct.select("hi", "lo", level.alias("level"), "prefix_len", "hit")
        .selectExpr(
            "level", "hi", "lo", "hit", "explode(sequence(0L, shiftleft(1L, level - prefix_len) - 1)) as i"
        )
        .selectExpr(
            "level",
            "if(level <= 64, hi | shiftleft(i, 64 - level), hi) as hi",
            "if(level <= 64, 0L, lo | shiftleft(i, 128 - level)) as lo",
            "hit",
        )
        .groupBy("level", "hi", "lo")
        .agg(F.max("hit").alias("hit"))
    )


def locate6(rows: DataFrame, networks: DataFrame, address: str = "ip") -> DataFrame:
    """Add ``hit``, the attributes of the longest network that holds ``address``, to rows.

    It is null for addresses in no network and for text that is no IPv6 address.
    """
    kept = rows.columns
    halves = ipv6_halves(address)
    wanted = rows.select(F.struct(*kept).alias("row"), halves.alias("at")).select(
        "row", F.col("at.hi").alias("hi"), F.col("at.lo").alias("lo")
    )
    known = wanted.where(F.col("hi").isNotNull())
    together = (
        network_pieces(networks)
        .unionByName(known, allowMissingColumns=True)
        .selectExpr("level", "hit", "row", f"hi ^ {_TURN}L as hi", f"lo ^ {_TURN}L as lo")
    )
    # Written once, so that the lanes stay as they were dealt.
    dealt = together.repartitionByRange("hi", "lo").withColumn("lane", F.spark_partition_id())
    dealt = stage(dealt, shared_folder(rows.sparkSession), "lanes")

    def piece(level: int) -> F.Column:
        return F.when(F.col("level") == level, F.struct("hi", "lo", "hit"))

    ends = dealt.groupBy("lane").agg(
        *[F.expr(f"max_by(struct(hi, lo, hit), struct(hi, lo)) filter (where level = {n})").alias(f"end_{n}") for n in LEVELS]
    )
    # One row per lane; all of them meet in one task.
    earlier = Window.partitionBy(F.col("lane") * 0).orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        F.col("lane").alias("of"), *[F.last(f"end_{n}", ignorenulls=True).over(earlier).alias(f"open_{n}") for n in LEVELS]
    )
    # Pieces come before the addresses at their start.
    so_far = Window.partitionBy("lane").orderBy("hi", "lo", F.col("level").asc_nulls_last())
    so_far = so_far.rowsBetween(Window.unboundedPreceding, 0)
    last = [F.last(piece(n), ignorenulls=True).over(so_far).alias(f"last_{n}") for n in LEVELS]
    found = (
        dealt.select("lane", "row", "hi", "lo", *last)
        .where("row is not null")
        .join(carried, F.col("lane") == F.col("of"))
    )

    def holding(n: int) -> str:
        p = f"coalesce(last_{n}, open_{n})"
        high = f"shiftright({p}.hi, {max(64 - n, 0)}) = shiftright(hi, {max(64 - n, 0)})"
        low = "true" if n <= 64 else f"shiftright({p}.lo, {128 - n}) = shiftright(lo, {128 - n})"
        return f"if({high} and {low}, {p}.hit, null)"

    hits = ", ".join(map(holding, LEVELS))
    located = found.select("row.*", F.expr(f"greatest({hits})").alias("hit"))
    none = wanted.where(F.col("hi").isNull()).select("row.*", F.lit(None).cast(located.schema["hit"].dataType).alias("hit"))
    return located.unionByName(none)
