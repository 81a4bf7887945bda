"""Traffic per time bucket, protocol mix and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wiretally.functions.columns import protocol_bucket, time_bucket
from wiretally.operators.ranking import dense_index
from wiretally.schema import BUCKETS

# Seconds sharing one numbering block: about 18 hours of one-second buckets.
_BLOCK_BITS = 16


def traffic_per_bucket(packets: DataFrame, width: int = 1) -> DataFrame:
    """``(capture, second, packets, bytes, HTTP .. others)`` in one pass.

    Only buckets with a packet appear. Callers take the columns they need and
    the optimizer drops the other aggregates with their input columns.
    """
    return packets.groupBy("capture", time_bucket(width).alias("second")).agg(*bucket_metrics())


def bucket_metrics() -> list[Column]:
    """The aggregates of a time bucket: ``packets, bytes, HTTP .. others``."""
    bucket = protocol_bucket()
    return [
        F.count("*").alias("packets"),
        F.sum("data_length").alias("bytes"),
        *[F.count_if(bucket == F.lit(b)).alias(b) for b in BUCKETS],
    ]


def with_index(series: DataFrame) -> DataFrame:
    """Add ``idx``: the position of each ``second`` within its capture."""
    return dense_index(series, "second", F.shiftright("second", _BLOCK_BITS))


def with_idle(series: DataFrame, width: int = 1) -> DataFrame:
    """``series`` with a row of zeros for each bucket without a packet between a capture's first and last.

    Idle buckets are made per numbering block, each block in a task that the
    shuffle gives it; the driver sees none of them. A capture's span decides how
    many rows there are.
    """
    metrics = [c for c in series.columns if c not in ("capture", "second")]
    step = width << _BLOCK_BITS
    spans = series.groupBy("capture").agg(F.min("second").alias("first"), F.max("second").alias("last"))
    blocks = spans.selectExpr("capture", "last", f"explode(sequence(first, last, {step}L)) as begin")
    idle = blocks.repartition("capture", "begin").selectExpr(
        "capture",
        f"explode(sequence(begin, least(begin + {step - width}L, last), {width}L)) as second",
        *[f"cast(0 as {dict(series.dtypes)[m]}) as {m}" for m in metrics],
    )
    return (
        series.unionByName(idle)
        .groupBy("capture", "second")
        .agg(*[F.sum(m).cast(dict(series.dtypes)[m]).alias(m) for m in metrics])
    )


def packets_per_second(packets: DataFrame, width: int = 1, idle: bool = False) -> DataFrame:
    """``(capture, second, idx, value)``: packets per bucket, those without one too if ``idle``."""
    return _series(packets, "packets", width, idle)


def bytes_per_second(packets: DataFrame, width: int = 1, idle: bool = False) -> DataFrame:
    """``(capture, second, idx, value)``: bytes per bucket, those without one too if ``idle``."""
    return _series(packets, "bytes", width, idle)


def _series(packets: DataFrame, metric: str, width: int, idle: bool) -> DataFrame:
    series = traffic_per_bucket(packets, width).select(
        "capture", "second", F.col(metric).alias("value")
    )
    if idle:
        series = with_idle(series, width)
    return with_index(series).select("capture", "second", "idx", "value")


def protocol_per_second(packets: DataFrame, width: int = 1) -> DataFrame:
    """``(capture, second, idx, HTTP, TCP, ICMP, UDP, others)``."""
    series = traffic_per_bucket(packets, width).select("capture", "second", *BUCKETS)
    return with_index(series).select("capture", "second", "idx", *BUCKETS)


def rate_summary(
    packets: DataFrame, metric: str = "packets", width: int = 1, idle: bool = False
) -> DataFrame:
    """``(capture, average, minimum, maximum)`` over the buckets with a packet.

    With ``idle`` those without one between a capture's first and last count as
    zeros; their number follows from the span, so none of them is made.
    """
    value = F.col(metric)
    totals = traffic_per_bucket(packets, width).groupBy("capture")
    average, minimum, maximum = F.avg(value), F.min(value), F.max(value)
    if idle:
        buckets = (F.max("second") - F.min("second")) / width + 1
        average = F.sum(value) / buckets
        minimum = F.when(F.count("*") < buckets, F.least(F.lit(0), minimum)).otherwise(minimum)
    return totals.agg(average.alias("average"), minimum.alias("minimum"), maximum.alias("maximum"))


def protocol_distribution(packets: DataFrame) -> DataFrame:
    """``(capture, bucket, n, buckets)``: packets per protocol and how many occur."""
    counts = packets.groupBy("capture", protocol_bucket().alias("bucket")).agg(
        F.count("*").alias("n")
    )
    # At most five rows per capture reach this window.
    present = F.count("*").over(Window.partitionBy("capture"))
    return counts.select("capture", "bucket", "n", present.alias("buckets"))


def protocol_map(packets: DataFrame) -> DataFrame:
    """``(capture, protocols)``: bucket to count, with the bucket count under ``x``."""
    entries = F.collect_list(F.struct("bucket", "n"))
    size = F.array(F.struct(F.lit("x").alias("bucket"), F.count("*").alias("n")))
    return (
        protocol_distribution(packets)
        .groupBy("capture")
        .agg(F.map_from_entries(F.concat(size, F.array_sort(entries))).alias("protocols"))
    )


def total_bytes(packets: DataFrame) -> DataFrame:
    """``(capture, total)``: all bytes of a capture."""
    return packets.groupBy("capture").agg(F.sum("data_length").alias("total"))
