"""Exact top-k and dense numbering that never sort a whole table in one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Up to this k Spark itself keeps only k rows per input partition before a ranking shuffle. The
# value is read to choose how rows are dealt; results and task sizes do not depend on it.
GROUP_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"
# Lanes of one round that meet in one lane of the next.
FAN_IN = 16


def lanes_by_round(tasks: int) -> list[int]:
    """How many lanes the rounds of a ranking over ``tasks`` tasks have, the last one aside."""
    rounds = []
    while tasks > 1:
        rounds.append(tasks)
        tasks = ceil(tasks / FAN_IN)
    return rounds


def top_k(
    df: DataFrame,
    k: int,
    metric: str = "n",
    ties: Sequence[str] = ("ip",),
    by: Sequence[str] = ("capture",),
) -> DataFrame:
    """The ``k`` rows of highest ``metric`` per group, with a ``rank`` from 1.

    ``ties`` (ascending) must make the order total. A tournament: each of the
    session's shuffle tasks ranks its own lane and forwards ``k`` rows of a group, ``FAN_IN``
    lanes meet in one, and so on to one lane per group. So a task sorts its share of
    the rows in the first round and at most ``FAN_IN * k`` later, whatever the
    optimizer does. A column ``rank`` of ``df`` is replaced.
    """
    if k < 1:
        raise ValueError("k must be positive")
    conf = df.sparkSession.conf
    rounds = lanes_by_round(int(conf.get("spark.sql.shuffle.partitions")))
    order = [F.col(metric).desc(), *[F.col(c).asc() for c in ties]]
    # A name that no column has.
    lane = "_lane" + "_" * max(map(len, df.columns))

    def ranked(rows: DataFrame, *groups: str) -> DataFrame:
        window = Window.partitionBy(*by, *groups).orderBy(*order)
        number = F.row_number().over(window)
        return rows.withColumn("rank", number).where(F.col("rank") <= k)

    if rounds:
        # Where Spark limits rows before the shuffle, a partition forwards k of them; otherwise
        # all rows move, and are dealt evenly. Any lanes leave the overall winners unchanged.
        limited = k <= int(conf.get(GROUP_LIMIT))
        number = F.spark_partition_id() if limited else F.xxhash64(*by, metric, *ties)
        df = df.withColumn(lane, F.pmod(number, F.lit(rounds[0])))
    for lanes in rounds:
        df = df.withColumn(lane, F.pmod(lane, F.lit(lanes)))
        df = ranked(df, lane).drop("rank")
    df = df.drop(lane)
    return ranked(df).withColumn("rank", F.col("rank").cast("bigint"))


def dense_index(
    df: DataFrame, order: str, block: Column, by: Sequence[str] = ("capture",)
) -> DataFrame:
    """Number the rows of each group 0, 1, 2, ... by ``order``, as ``idx``.

    ``block`` is a coarser value that rises with ``order`` and is shared by a
    bounded number of rows. Rows are sorted inside their block only; the block
    sizes alone, one row per block, are summed up along the group. Columns named
    ``idx``, ``_block`` or ``_rows`` are replaced.
    """
    rest = [c for c in df.columns if c not in by and c != order]
    blocks = (
        df.withColumn("_block", block)
        .groupBy(*by, "_block")
        .agg(F.sort_array(F.collect_list(F.struct(order, *rest))).alias("_rows"))
    )
    before = (
        Window.partitionBy(*by)
        .orderBy("_block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = blocks.select(*by, "_block", F.size("_rows").alias("_size")).select(
        *by, "_block", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start")
    )
    # Null-safe equality adds no filter to either side, so both sides keep the
    # same shuffle of blocks and Spark runs it once.
    same = [F.col(f"b.{c}").eqNullSafe(F.col(f"s.{c}")) for c in (*by, "_block")]
    return (
        blocks.alias("b")
        .join(starts.alias("s"), reduce(Column.__and__, same))
        .select(
            *[F.col(f"b.{c}") for c in by],
            "_start",
            F.posexplode("_rows").alias("_pos", "_row"),
        )
        .select(
            *by,
            *[F.col(f"_row.{c}").alias(c) for c in (order, *rest)],
            (F.col("_start") + F.col("_pos")).cast("bigint").alias("idx"),
        )
    )
