"""Totals kept per source, capture and day, so that a new file needs no rebuild.

Each source (a capture file, say) leaves mergeable partial totals, and adding it
again replaces its own. Sums, counts, first and last times merge by sum, least
and greatest, so totals over any choice of sources and days equal those over
their packets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wiretally.functions.columns import epoch_second, wall_clock
from wiretally.operators.rates import traffic_per_bucket
from wiretally.schema import BUCKETS, ROLES

_DAY = "source string, capture string, day date"
_PAIRS = f"src string, dst string, n bigint, bytes bigint, first double, last double, {_DAY}"
_SECONDS = f"second bigint, packets bigint, bytes bigint, {', '.join(f'{b} bigint' for b in BUCKETS)}, {_DAY}"


def add_source(packets: DataFrame, folder: str, source: str) -> None:
    """Keep the partial totals of ``packets`` as those of ``source``; what it had there is replaced.

    Only days that ``source`` has no packets of any more stay as they were.
    """
    day = wall_clock(epoch_second()).cast("date")
    pairs = packets.groupBy("capture", day.alias("day"), "src", "dst").agg(
        F.count("*").alias("n"),
        F.sum("data_length").alias("bytes"),
        F.min("arrival_time").alias("first"),
        F.max("arrival_time").alias("last"),
    )
    seconds = traffic_per_bucket(packets).withColumn("day", wall_clock(F.col("second")).cast("date"))
    for name, rows in (("pairs", pairs), ("seconds", seconds)):
        (
            rows.withColumn("source", F.lit(source))
            # Rows of one day are written by one task of the hash of their own, not all by one.
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("source", "capture", "day")
            .parquet(f"{folder}/{name}")
        )


def _kept(spark: SparkSession, folder: str, name: str, schema: str, days: tuple | None) -> DataFrame:
    rows = spark.read.schema(schema).parquet(f"{folder}/{name}")
    return rows if days is None else rows.where(F.col("day").between(*map(F.lit, days)))


def pair_totals(spark: SparkSession, folder: str, days: tuple | None = None) -> DataFrame:
    """``(capture, src, dst, n, bytes)`` over all sources, of the days from first to last if given."""
    kept = _kept(spark, folder, "pairs", _PAIRS, days)
    return kept.groupBy("capture", "src", "dst").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))


def host_totals(spark: SparkSession, folder: str, days: tuple | None = None) -> DataFrame:
    """``(capture, role, ip, packets, bytes, first_connection, last_connection)``."""
    ends = F.array(*[F.struct(F.lit(r).alias("role"), F.col(r).alias("ip")) for r in ROLES])
    return (
        _kept(spark, folder, "pairs", _PAIRS, days)
        .select("capture", "n", "bytes", "first", "last", F.explode(ends).alias("end"))
        .groupBy("capture", "end.role", "end.ip")
        .agg(
            F.sum("n").alias("packets"),
            F.sum("bytes").alias("bytes"),
            F.min("first").alias("first_connection"),
            F.max("last").alias("last_connection"),
        )
    )


def traffic_totals(spark: SparkSession, folder: str, days: tuple | None = None) -> DataFrame:
    """``(capture, second, packets, bytes, HTTP .. others)``, as ``rates.traffic_per_bucket`` has it."""
    kept = _kept(spark, folder, "seconds", _SECONDS, days)
    return kept.groupBy("capture", "second").agg(
        *[F.sum(c).alias(c) for c in ("packets", "bytes", *BUCKETS)]
    )
