"""Packet captures: comma-separated exporter text, or typed tables."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from wiretally.functions.columns import MAX_SECOND, MIN_SECOND, number
from wiretally.schema import PACKET_SCHEMA

FIELD_COUNT = 6


def _typed(lines: DataFrame, *keep: str) -> DataFrame:
    """Split ``value`` and type the six fields; ``reject`` says why a line fails.

    Columns of ``lines`` to ``keep`` stay beside them.

    Exactly six fields are wanted and blanks count as fields. The arity is
    tested on the split itself rather than left to a CSV reader, whose
    malformed-row handling depends on the columns a query happens to read.

    The one-element explodes keep the optimizer from copying the split and the
    conversions into every later test, as it would with plain projections.
    """
    fields = lines.select(*keep, F.explode(F.array(F.split("value", ","))).alias("f"))
    text = [F.get("f", F.lit(i)) for i in range(FIELD_COUNT)]
    numbers = F.struct(
        number(text[2]).try_cast("bigint").alias("length"), number(text[5]).alias("arrival")
    )
    converted = fields.select(*keep, "f", F.inline(F.array(numbers)))
    arrival = F.col("arrival")
    typed = converted.select(
        *keep,
        F.size("f").alias("n"),
        text[0].alias("src"),
        text[1].alias("dst"),
        F.col("length").alias("data_length"),
        text[3].alias("protocol_name"),
        text[4].try_cast("int").alias("protocol_number"),
        F.when(arrival.between(MIN_SECOND, MAX_SECOND), arrival).alias("arrival_time"),
    )
    reason = (
        F.when(F.col("n") != FIELD_COUNT, "arity")
        .when(F.col("data_length").isNull(), "data_length")
        .when(F.col("arrival_time").isNull(), "arrival_time")
    )
    return typed.select("*", reason.alias("reject"))


def parse_lines(lines: DataFrame, capture: str, drop_blank_ip: bool = False) -> DataFrame:
    """Typed packets from a ``value`` column of exporter lines."""
    packets = (
        _typed(lines)
        .where(F.col("reject").isNull())
        .withColumn("capture", F.lit(capture))
        .select(*PACKET_SCHEMA.fieldNames())
    )
    if drop_blank_ip:
        packets = packets.where((F.col("src") != "") & (F.col("dst") != ""))
    return packets


def _by_reason(rows: DataFrame) -> DataFrame:
    return (
        rows.where(F.col("reject").isNotNull())
        .groupBy(F.col("reject").alias("reason"))
        .agg(F.count("*").alias("n"))
    )


def count_rejects(lines: DataFrame) -> DataFrame:
    """``(reason, n)`` for the lines ``parse_lines`` leaves out."""
    return _by_reason(_typed(lines))


def count_capture_rejects(
    spark: SparkSession, paths: Mapping[str, str | list[str]]
) -> DataFrame:
    """``(capture, reason, n)`` for the lines ``read_captures`` leaves out."""
    counts = [
        count_rejects(spark.read.text(path)).select(F.lit(name).alias("capture"), "reason", "n")
        for name, path in paths.items()
    ]
    return union_captures(counts)


def read_packets(
    spark: SparkSession, path: str | list[str], capture: str, drop_blank_ip: bool = False
) -> DataFrame:
    """One labelled capture from exporter text files."""
    return parse_lines(spark.read.text(path), capture, drop_blank_ip)


def read_captures(
    spark: SparkSession, paths: Mapping[str, str | list[str]], drop_blank_ip: bool = False
) -> DataFrame:
    """Several captures as one table; ``paths`` maps label to path."""
    return union_captures(
        [read_packets(spark, path, name, drop_blank_ip) for name, path in paths.items()]
    )


def split_captures(
    spark: SparkSession, paths: Mapping[str, str | list[str]], folder: str
) -> tuple[DataFrame, DataFrame]:
    """The packets of several captures and their unusable lines, from one pass over the text.

    Both are written to ``folder`` by one job, side by side as lines come, and read
    back by the column ``usable``. Folders for it and for the capture would have every task
    sort its lines with their text first; so a file has lines of one capture, and
    row groups of another one, or without a rejected line, are left out by their
    statistics. Rejected lines have ``capture, file, reason, line``;
    ``count_rejected`` counts them by reason.
    """
    parts = []
    for name, path in paths.items():
        text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
        parts.append(_typed(text, "value", "file").withColumn("capture", F.lit(name)))
    usable = F.col("reject").isNull()
    union_captures(parts).select(
        *PACKET_SCHEMA.fieldNames(),
        usable.alias("usable"),
        F.when(~usable, F.col("file")).alias("file"),
        F.col("reject").alias("reason"),
        F.when(~usable, F.col("value")).alias("line"),
    ).write.mode("overwrite").parquet(folder)
    kept = StructType([*PACKET_SCHEMA.fields, StructField("usable", BooleanType())])
    kept = kept.add("file", "string").add("reason", "string").add("line", "string")
    both = spark.read.schema(kept).parquet(folder)
    return (
        both.where("usable").select(*PACKET_SCHEMA.fieldNames()),
        both.where("not usable").select("capture", "file", "reason", "line"),
    )


def count_rejected(rejects: DataFrame) -> DataFrame:
    """``(capture, reason, n)`` for lines that ``split_captures`` rejected."""
    return rejects.groupBy("capture", "reason").agg(F.count("*").alias("n"))


def union_captures(captures: list[DataFrame]) -> DataFrame:
    if not captures:
        raise ValueError("at least one capture is needed")
    return reduce(DataFrame.unionByName, captures)


def _fitted(packets: DataFrame) -> DataFrame:
    """The packet schema's columns; ``reject`` says why a row can't be used."""
    columns = []
    for field in PACKET_SCHEMA.fields:
        column = F.col(field.name).try_cast(field.dataType)
        if field.name in ("src", "dst"):
            column = F.coalesce(column, F.lit(""))
        columns.append(column.alias(field.name))
    in_time = F.col("arrival_time").between(MIN_SECOND, MAX_SECOND)
    reason = F.when(F.col("data_length").isNull(), "data_length").when(
        ~F.coalesce(in_time, F.lit(False)), "arrival_time"
    )
    return packets.select(*columns).withColumn("reject", reason)


def conform(packets: DataFrame) -> DataFrame:
    """Fit an already typed table to the packet schema; null addresses become blank."""
    return _fitted(packets).where(F.col("reject").isNull()).drop("reject")


def count_typed_rejects(packets: DataFrame) -> DataFrame:
    """``(reason, n)`` for the rows ``conform`` leaves out."""
    return _by_reason(_fitted(packets))


def write_packets(packets: DataFrame, path: str) -> DataFrame:
    """Keep typed packets as Parquet split by capture, and read them back.

    Text has to be split again for every statistic; over this copy each one
    reads only its own columns and captures.
    """
    packets.write.mode("overwrite").partitionBy("capture").parquet(path)
    return packets.sparkSession.read.schema(PACKET_SCHEMA).parquet(path).select(
        *PACKET_SCHEMA.fieldNames()
    )


def packet_text(packets: DataFrame) -> DataFrame:
    """``(value)``: packets as lines of the exporter's six-field form."""
    six = [c for c in PACKET_SCHEMA.fieldNames() if c != "capture"]
    line = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in six])
    return packets.select(line.alias("value"))


def write_packet_text(packets: DataFrame, path: str) -> None:
    """Write packets in the exporter's six-field form, without a header."""
    packet_text(packets).write.mode("overwrite").text(path)
