"""Packet and block views over the analytics test tables.

Traffic is derived from ``events`` and IP blocks from ``nation`` and
``region``, so every registered query reads those tables whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wiretally.schema import GEO_SCHEMA, PACKET_SCHEMA

FIRST_ADDRESS = 10 * 2**24  # 10.0.0.0


def packets_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One packet per event; a quarter of the events are the attack capture."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    # The clock fields of a zone-less timestamp do not depend on the session zone.
    micros = F.expr(
        "(unix_date(cast(ts as date)) * 86400L + hour(ts) * 3600 + minute(ts) * 60) * 1000000L"
        " + cast(extract(second from ts) * 1000000 as bigint)"
    )
    protocol = F.expr(
        "case event_type when 'click' then 'TCP' when 'view' then 'HTTP'"
        " when 'purchase' then 'UDP' when 'error' then 'ICMP' else 'DNS' end"
    )
    number = F.expr(
        "case event_type when 'click' then 6 when 'view' then 6 when 'error' then 1 else 17 end"
    )
    return events.select(
        F.expr("case when event_id % 4 = 0 then 'attack' else 'normal' end").alias("capture"),
        F.expr("concat('10.0.', user_id div 256, '.', user_id % 256)").alias("src"),
        F.expr("concat('10.0.0.', cast(get_json_object(props, '$.k') as int) % 10)").alias("dst"),
        F.expr("cast(floor(value) as bigint) + 60").alias("data_length"),
        protocol.alias("protocol_name"),
        number.alias("protocol_number"),
        (micros / F.lit(1_000_000.0)).alias("arrival_time"),
    ).select(*PACKET_SCHEMA.fieldNames())


def packet_lines_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every packet as an exporter line, with four broken lines beside each.

    The broken ones have five and eight fields, a worded length and a worded
    time. ``capture`` stays as a column.
    """
    p = packets_view(spark, sf_dir)

    def line(*fields):
        return F.concat_ws(",", *[f if not isinstance(f, str) else F.col(f) for f in fields])

    six = ("src", "dst", "data_length", "protocol_name", "protocol_number", "arrival_time")
    return p.select(
        "capture",
        F.explode(
            F.array(
                line(*six),
                line(*six[:5]),
                line("src", "dst", "dst", "data_length", "protocol_name", *six[4:], six[4]),
                line("src", "dst", F.lit("abc"), *six[3:]),
                line(*six[:5], F.lit("noon")),
            )
        ).alias("value"),
    )


def geo_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A six-address block per nation and, across some of them, a /26 per region."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    region = spark.read.parquet(f"{sf_dir}/region.parquet")
    narrow = nation.select(
        (F.lit(FIRST_ADDRESS) + F.col("n_nationkey") * 8).cast("bigint").alias("ip_from"),
        (F.lit(FIRST_ADDRESS) + F.col("n_nationkey") * 8 + 5).cast("bigint").alias("ip_to"),
        F.lit(29).alias("prefix_len"),
        F.col("n_name").alias("country"),
        F.concat(F.lit("CITY_"), F.col("n_nationkey")).alias("city"),
        F.expr("case when n_nationkey % 7 != 0 then n_nationkey * 1.5D end").alias("latitude"),
        F.expr("n_nationkey * -2.5D - 1D").alias("longitude"),
    )
    wide = region.select(
        (F.lit(FIRST_ADDRESS + 64) + F.col("r_regionkey") * 256).cast("bigint").alias("ip_from"),
        (F.lit(FIRST_ADDRESS + 127) + F.col("r_regionkey") * 256).cast("bigint").alias("ip_to"),
        F.lit(26).alias("prefix_len"),
        F.col("r_name").alias("country"),
        F.lit(None).cast("string").alias("city"),
        F.expr("r_regionkey * 3D + 0.5D").alias("latitude"),
        F.expr("r_regionkey * 4D + 0.25D").alias("longitude"),
    )
    return narrow.unionByName(wide).select(*GEO_SCHEMA.fieldNames())


def rough_packets(packets: DataFrame) -> DataFrame:
    """The packets with some lengths missing and some times past the year 9999."""
    return packets.withColumn(
        "arrival_time", F.expr("if(data_length % 5 = 0, 1e15D, arrival_time)")
    ).withColumn("data_length", F.expr("if(data_length % 7 = 0, null, data_length)"))


def networks_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks by CIDR text; those without latitude are IPv6, the wider ones no address."""
    offset = F.col("ip_from") - FIRST_ADDRESS
    network = F.when(F.col("latitude").isNull(), F.lit("2001:db8::")).otherwise(
        F.concat(F.lit("10.0.0."), offset.cast("string"))
    )
    return geo_view(spark, sf_dir).select(
        F.concat_ws("/", network, "prefix_len").alias("network"),
        "country",
        "city",
        "latitude",
        "longitude",
    )


def rough_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks by bounds, some of them reversed."""
    turned = "ip_from % 3 = 0"
    return geo_view(spark, sf_dir).select(
        F.expr(f"if({turned}, ip_to, ip_from)").alias("ip_from"),
        F.expr(f"if({turned}, ip_from, ip_to)").alias("ip_to"),
    )


def mixed_networks_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Networks of both families: a /46 and a longer /48 per nation and a /24 of IPv4, a /30 per region.

    Nation n has 2001:db8:4n::/46 and within it 2001:db8:4n+1::/48, and
    10.0.n.0/24; region r has 2001:db0+8r::/29, one of which holds all nations.
    """
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    region = spark.read.parquet(f"{sf_dir}/region.parquet")
    key, names = F.col("n_nationkey"), ("network", "country", "city", "latitude", "longitude")

    def group(value) -> F.Column:
        return F.lower(F.hex(value))

    def rows(table, network, name, city, latitude):
        place = (latitude, F.lit(0.5) - latitude)
        return table.select(*[c.alias(n) for c, n in zip((network, name, city, *place), names, strict=True)])

    none = F.lit(None).cast("string")
    return (
        rows(nation, F.concat(F.lit("2001:db8:"), group(key * 4), F.lit("::/46")), F.col("n_name"), none, key * F.lit(1.5))
        .union(
            rows(
                nation, F.concat(F.lit("2001:0DB8:"), group(key * 4 + 1), F.lit(":0::0/48")), F.col("n_name"),
                F.concat(F.lit("CITY_"), key), key * F.lit(2.5),
            )
        )
        .union(rows(nation, F.concat(F.lit("10.0."), key, F.lit(".0/24")), F.col("n_name"), none, key * F.lit(3.5)))
        .union(
            rows(
                region, F.concat(F.lit("2001:"), group(F.col("r_regionkey") * 8 + 0xDB0), F.lit("::/29")),
                F.col("r_name"), none, F.col("r_regionkey") * F.lit(1.0),
            )
        )
    )


def mixed_addresses_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts of both families: each user's IPv6 and mapped address beside the packets' own."""
    users = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id")
    net, host = F.expr("user_id % 128"), F.expr("user_id div 128 % 256")
    six = F.concat(F.lit("2001:db8:"), F.lower(F.hex(net)), F.lit("::"), F.lower(F.hex(host + 1)))
    mapped = F.concat(F.lit("::FFFF:10.0."), net, F.lit("."), host)
    other = F.concat(F.lit("2001:db"), F.lower(F.hex(F.expr("user_id % 16"))), F.lit(":ffff:0:0:0:0:1"))
    return users.select(F.explode(F.array(six, mapped, other, F.lit("2001:db8::g"))).alias("ip")).union(
        packets_view(spark, sf_dir).select("src")
    )
