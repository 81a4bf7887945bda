"""Traffic totals of captures that still grow, by Structured Streaming.

Two results from one stream of packets. ``keep_totals`` merges every batch into
the kept totals of ``operators.totals``: exact at any time and in any order of
arrival, with no state. ``closed_buckets`` has each time bucket once, as soon as
the watermark says that it is over; its state holds the open buckets only, and
packets that come later than the watermark allows are not in it. ``corrections``
lists what these and the open buckets add.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wiretally.functions.columns import time_bucket
from wiretally.operators.rates import bucket_metrics
from wiretally.operators.totals import add_source
from wiretally.schema import BUCKETS, PACKET_SCHEMA
from wiretally.sources.packets import parse_lines, union_captures

LATENESS = "10 minutes"


def stream_captures(
    spark: SparkSession, folders: Mapping[str, str], files: int = 1000, drop_blank_ip: bool = False
) -> DataFrame:
    """Packets of the exporter text files that appear in each capture's folder, up to ``files`` a batch."""
    reader = spark.readStream.option("maxFilesPerTrigger", files)
    return union_captures(
        [parse_lines(reader.text(folder), name, drop_blank_ip) for name, folder in folders.items()]
    )


def stream_packets(spark: SparkSession, folder: str, files: int = 1000) -> DataFrame:
    """Packets of the typed Parquet files that appear in ``folder``, up to ``files`` a batch."""
    reader = spark.readStream.schema(PACKET_SCHEMA).option("maxFilesPerTrigger", files)
    return reader.parquet(folder).select(*PACKET_SCHEMA.fieldNames())


def keep_totals(
    packets: DataFrame, folder: str, checkpoint: str, name: str = "stream", **trigger
) -> StreamingQuery:
    """Start a query that adds each batch of ``packets`` to the totals kept in ``folder``.

    A batch is a source of its own, named after its number, so one that is
    repeated after a failure replaces what it left. ``name`` belongs to one
    ``checkpoint``. Packets count however late they come. A stream that never had
    a packet leaves empty totals. ``trigger`` goes to the writer; without one
    the files present now are read and the query ends.
    """
    # Makes the folders, for readers that come before the first batch.
    add_source(packets.sparkSession.createDataFrame([], PACKET_SCHEMA), folder, name)

    def add(batch: DataFrame, number: int) -> None:
        add_source(batch, folder, f"{name}-{number}")

    writer = packets.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def closed_buckets(packets: DataFrame, width: int = 1, lateness: str = LATENESS) -> DataFrame:
    """``(capture, second, packets, bytes, HTTP .. others)`` of the buckets that are over.

    A bucket is over when a packet has been seen whose own bucket begins
    ``lateness`` or more after its end, in any capture. Packets of a bucket that is over are
    left out; Spark counts them as rows dropped by the watermark.
    """
    timed = packets.withColumn("at", F.timestamp_seconds(time_bucket(width))).withWatermark("at", lateness)
    return (
        timed.groupBy("capture", F.window("at", f"{width} seconds").alias("bucket"))
        .agg(*bucket_metrics())
        .select("capture", F.unix_seconds("bucket.start").alias("second"), "packets", "bytes", *BUCKETS)
    )


def write_closed(closed: DataFrame, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start a query that writes each closed bucket once, as Parquet in ``folder``."""
    writer = closed.writeStream.outputMode("append").format("parquet").option("path", folder)
    writer = writer.option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def corrections(traffic: DataFrame, closed: DataFrame) -> DataFrame:
    """What ``traffic``, over all packets, has beyond ``closed``: open buckets, and packets that came late."""
    metrics = ("packets", "bytes", *BUCKETS)
    minus = closed.select("capture", "second", *[(-F.col(m)).alias(m) for m in metrics])
    return (
        traffic.unionByName(minus)
        .groupBy("capture", "second")
        .agg(*[F.sum(m).alias(m) for m in metrics])
        .where(F.col("packets") != 0)
    )
