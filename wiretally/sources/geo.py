"""IP-block tables: explicit ranges, CIDR networks, or blocks with locations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wiretally.functions.columns import ip_to_long, ipv6_halves
from wiretally.schema import GEO_SCHEMA, NETWORK6_SCHEMA


def _bounds_from_cidr(table: DataFrame, network: str) -> DataFrame:
    """Every row with ``ip_from``, ``ip_to``, ``prefix_len``; null bounds if no IPv4 CIDR."""
    parts = F.split(network, "/")
    length = F.get(parts, F.lit(1)).try_cast("int")
    named = table.withColumn("_base", F.get(parts, F.lit(0))).withColumn(
        "prefix_len", F.when((F.size(parts) == 2) & length.between(0, 32), length)
    )
    base = ip_to_long("_base")
    return (
        named.withColumn("_size", F.expr("shiftleft(1L, 32 - prefix_len)"))
        .withColumn("ip_from", base - base % F.col("_size"))
        .withColumn("ip_to", F.col("ip_from") + F.col("_size") - 1)
        .drop("_base", "_size")
    )


def _halves_from_cidr(table: DataFrame, network: str) -> DataFrame:
    """Every row with ``hi``, ``lo`` and ``prefix_len``; null halves if no IPv6 CIDR.

    Bits beyond the prefix are cleared.
    """
    parts = F.split(network, "/")
    length = F.get(parts, F.lit(1)).try_cast("int")
    halves = ipv6_halves("_base")
    # A shift by 64 would be none.
    keep_hi = F.expr("if(prefix_len <= 0, 0L, shiftleft(-1L, 64 - least(prefix_len, 64)))")
    keep_lo = F.expr("if(prefix_len <= 64, 0L, shiftleft(-1L, 128 - prefix_len))")
    return (
        table.withColumn("_base", F.get(parts, F.lit(0)))
        .withColumn("prefix_len", F.when((F.size(parts) == 2) & length.between(0, 128), length))
        .withColumn("_halves", F.when(F.col("prefix_len").isNotNull(), halves))
        .withColumn("hi", F.col("_halves.hi").bitwiseAND(keep_hi))
        .withColumn("lo", F.col("_halves.lo").bitwiseAND(keep_lo))
        .drop("_base", "_halves")
    )


def conform_networks6(table: DataFrame, network: str = "network") -> DataFrame:
    """The IPv6 networks of a block table with a CIDR column, fit to their schema."""
    found = _halves_from_cidr(table, network).where(F.col("hi").isNotNull())
    columns = [
        (F.col(f.name) if f.name in found.columns else F.lit(None)).try_cast(f.dataType).alias(f.name)
        for f in NETWORK6_SCHEMA.fields
    ]
    return found.select(*columns)


def blocks_from_cidr(table: DataFrame, network: str = "network") -> DataFrame:
    """Replace a CIDR column by ``ip_from``, ``ip_to`` and ``prefix_len``.

    Rows whose network is not IPv4 CIDR text are left out; ``conform_networks6`` takes
    those of IPv6 and ``count_block_rejects`` counts the others.
    """
    return _bounds_from_cidr(table, network).where(F.col("ip_from").isNotNull())


def count_block_rejects(table: DataFrame) -> DataFrame:
    """``(reason, n)`` for the rows of a block table that locate nothing.

    ``network`` is text other than IPv4 or IPv6 CIDR, ``range`` a missing or
    reversed range or one outside IPv4.
    """
    if "ip_from" in table.columns:
        low, high = (F.col(c).try_cast("bigint") for c in ("ip_from", "ip_to"))
        usable, reason = (low >= 0) & (high < 2**32) & (low <= high), "range"
    else:
        table = _halves_from_cidr(_bounds_from_cidr(table, "network"), "network")
        usable, reason = F.col("ip_from").isNotNull() | F.col("hi").isNotNull(), "network"
    return (
        table.where(~F.coalesce(usable, F.lit(False)))
        .groupBy(F.lit(reason).alias("reason"))
        .agg(F.count("*").alias("n"))
    )


def conform_blocks(table: DataFrame) -> DataFrame:
    """Fit a block table to the geo schema; missing or unreadable values
    become null.

    Takes either ``ip_from``/``ip_to`` bounds, both inclusive, or ``network``.
    Without ``prefix_len`` a range counts as specific as its width.
    """
    if "ip_from" not in table.columns:
        table = blocks_from_cidr(table)
    if "prefix_len" not in table.columns:
        width = F.col("ip_to").try_cast("bigint") - F.col("ip_from").try_cast("bigint") + 1
        table = table.withColumn("prefix_len", F.lit(32) - F.ceil(F.log2(width)))
    columns = [
        (F.col(f.name) if f.name in table.columns else F.lit(None))
        .try_cast(f.dataType)
        .alias(f.name)
        for f in GEO_SCHEMA.fields
    ]
    return table.select(*columns)


def read_block_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A block table as it is, from Parquet or from CSV with a header."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.load(path)


def read_geo_blocks(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Block table from Parquet, or from CSV with a header."""
    return conform_blocks(read_block_table(spark, path, fmt))


def read_network_locations(
    spark: SparkSession, blocks_path: str, locations_path: str
) -> DataFrame:
    """IPv4 block table from the two-file CSV form of a public city database."""
    return conform_blocks(network_locations(spark, blocks_path, locations_path))


def network_locations(
    spark: SparkSession, blocks_path: str | list[str], locations_path: str
) -> DataFrame:
    """The networks of both address families of such a database, with names and coordinates.

    Blocks carry ``network``, ``geoname_id`` and coordinates; locations carry
    ``geoname_id`` with country and city names. The join has no size hint, so
    Spark chooses from the sizes of the files.
    """
    blocks = spark.read.option("header", True).csv(blocks_path)
    locations = (
        spark.read.option("header", True)
        .csv(locations_path)
        .select(
            "geoname_id",
            F.col("country_name").alias("country"),
            F.col("city_name").alias("city"),
        )
    )
    return blocks.select("network", "geoname_id", "latitude", "longitude").join(
        locations, "geoname_id", "left"
    )
