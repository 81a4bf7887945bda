"""Behaviour of listed hosts in both roles.

Most other hosts' packets are dropped by a Bloom filter of the list before they
are doubled, once per role; a semi join with the list then decides exactly. The
filter is a small table of bounded size, so it is broadcast however long the
list is. The list is staged, so that Spark knows its size when the packets are
planned: a short one is broadcast to the semi join as well; beyond the session's
threshold what the filter left over and the list are shuffled, where adaptive
execution splits a very busy host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiretally.functions.columns import epoch_second, wall_clock
from wiretally.operators.geo import Blocks, geo_lookup
from wiretally.schema import ROLES
from wiretally.sinks import shared_folder, stage

# 64-bit words of a host filter, 2 MB at most. A longer list fills them further
# and lets more packets through to the semi join.
_FILTER_WORDS = 1 << 17
_HOSTS_PER_WORD = 4


def role_rows(packets: DataFrame, *columns: str) -> DataFrame:
    """Each packet twice: once for its source and once for its destination.

    Adds ``role``, ``ip`` and ``peer`` to ``capture`` and the wanted columns.
    """
    ends = [
        F.struct(F.lit(role).alias("role"), F.col(role).alias("ip"), F.col(peer).alias("peer"))
        for role, peer in (ROLES, ROLES[::-1])
    ]
    return packets.select("capture", *columns, F.explode(F.array(*ends)).alias("end")).select(
        "capture", "end.role", "end.ip", "end.peer", *columns
    )


def staged_list(hosts: DataFrame) -> DataFrame:
    """The list written or persisted once, so that planning knows its size."""
    return stage(hosts, shared_folder(hosts.sparkSession), "hosts")


def filter_words(listed: DataFrame) -> int:
    """How many words the filter of a staged list takes: a power of two, ``_FILTER_WORDS`` at most."""
    wanted = listed.count() // _HOSTS_PER_WORD
    return min(_FILTER_WORDS, 1 << wanted.bit_length())


def _word(ip: str, words: int) -> Column:
    return F.pmod(F.xxhash64("capture", ip), F.lit(words))


def _bits(ip: str) -> Column:
    """Four bits of a host's word, some of them perhaps the same."""
    bits = f"xxhash64(1, capture, `{ip}`)"
    return F.expr(" | ".join(f"shiftleft(1L, int(shiftright({bits}, {6 * i}) & 63L))" for i in range(4)))


def host_filter(listed: DataFrame, words: int) -> DataFrame:
    """``(word, bits)``: a Bloom filter of the hosts, each with its bits in one word.

    Filters of the same ``words`` merge by ``bit_or`` of their bits.
    """
    return listed.groupBy(_word("ip", words).alias("word")).agg(F.bit_or(_bits("ip")).alias("bits"))


def maybe_listed(packets: DataFrame, listed: DataFrame) -> DataFrame:
    """The packets of which an end may be in the staged list: all that are, and a few others."""
    words = filter_words(listed)
    held, hits = packets, F.lit(False)
    for role in ROLES:
        word, bits = f"_{role}_word", f"_{role}_bits"
        # At most _FILTER_WORDS rows of two numbers.
        side = F.broadcast(host_filter(listed, words).toDF(word, bits))
        held = held.join(side, _word(role, words) == F.col(word), "left")
        hits = hits | (F.coalesce(bits, F.lit(0)).bitwiseAND(_bits(role)) == _bits(role))
    return held.where(hits).select(packets.columns)


def _listed(
    packets: DataFrame, columns: list[str], hosts: DataFrame, keys: list[Column], *aggregates: Column
) -> DataFrame:
    """Aggregate the packets of a staged list's hosts by ``capture, ip, role`` and ``keys``."""
    listed = hosts.select("capture", "ip")
    rows = role_rows(maybe_listed(packets, listed), *columns)
    wanted = rows.join(listed, ["capture", "ip"], "left_semi")
    return wanted.groupBy("capture", "ip", "role", *keys).agg(*aggregates)


def _hour(zone: str) -> Column:
    return F.hour(wall_clock(epoch_second(), zone)).alias("hour")


def role_totals_of(packets: DataFrame, listed: DataFrame, zone: str = "UTC") -> DataFrame:
    """``(capture, ip, role, protocol_name, hour, packets, bytes, first, last)`` for a staged list.

    The one pass from which profiles, protocols and hours are added up.
    """
    return _listed(
        packets,
        ["data_length", "protocol_name", "arrival_time"],
        listed,
        [F.col("protocol_name"), _hour(zone)],
        F.count("*").alias("packets"),
        F.sum("data_length").alias("bytes"),
        F.min("arrival_time").alias("first"),
        F.max("arrival_time").alias("last"),
    )


def role_sums(totals: DataFrame) -> DataFrame:
    """``(capture, ip, role, packets, bytes, first_connection, last_connection)``."""
    return totals.groupBy("capture", "ip", "role").agg(
        F.sum("packets").alias("packets"),
        F.sum("bytes").alias("bytes"),
        F.min("first").alias("first_connection"),
        F.max("last").alias("last_connection"),
    )


def summed_rates(totals: DataFrame, key: str) -> DataFrame:
    """``(capture, ip, role, key, rate)``: packets by ``protocol_name`` or ``hour``."""
    return totals.groupBy("capture", "ip", "role", key).agg(F.sum("packets").alias("rate"))


def host_packets(packets: DataFrame, hosts: DataFrame) -> DataFrame:
    """``(capture, ip, role, packets)`` of the listed hosts; roles not taken are left out."""
    return _listed(packets, [], staged_list(hosts), [], F.count("*").alias("packets"))


def host_protocols(packets: DataFrame, hosts: DataFrame) -> DataFrame:
    """``(capture, ip, role, protocol_name, rate)`` with the names as captured."""
    column = "protocol_name"
    return _listed(packets, [column], staged_list(hosts), [F.col(column)], F.count("*").alias("rate"))


def host_hours(packets: DataFrame, hosts: DataFrame, zone: str = "UTC") -> DataFrame:
    """``(capture, ip, role, hour, rate)``: packets by hour of day in ``zone``."""
    columns = ["arrival_time"]
    return _listed(packets, columns, staged_list(hosts), [_hour(zone)], F.count("*").alias("rate"))


def profile_rows(sums: DataFrame, located: DataFrame) -> DataFrame:
    """Every listed host in both roles, with zeros and nulls for a role not taken."""
    both = located.withColumn("role", F.explode(F.array(*map(F.lit, ROLES))))
    return both.join(sums, ["capture", "ip", "role"], "left").select(
        "capture",
        "listed_as",
        "rank",
        "ip",
        "role",
        F.coalesce("packets", F.lit(0)).alias("packets"),
        F.coalesce("bytes", F.lit(0)).alias("bytes"),
        "first_connection",
        "last_connection",
        "country",
    )


def with_country(listed: DataFrame, places: DataFrame) -> DataFrame:
    """``listed`` with the ``country`` that ``places`` has for its ``ip``."""
    return listed.join(places.select("ip", "country"), "ip", "left")


def host_profile(packets: DataFrame, hosts: DataFrame, blocks: Blocks) -> DataFrame:
    """Packets, bytes, first and last packet and country per listed host and role.

    ``hosts`` has ``capture, listed_as, rank, ip``.
    """
    listed = staged_list(hosts.select("capture", "listed_as", "rank", "ip"))
    sums = _listed(
        packets,
        ["data_length", "arrival_time"],
        listed,
        [],
        F.count("*").alias("packets"),
        F.sum("data_length").alias("bytes"),
        F.min("arrival_time").alias("first_connection"),
        F.max("arrival_time").alias("last_connection"),
    )
    return profile_rows(sums, with_country(listed, geo_lookup(listed, blocks)))


def host_peer_countries(packets: DataFrame, hosts: DataFrame, blocks: Blocks) -> DataFrame:
    """``(capture, ip, role, country, rate)``: packets by country of the other end.

    Each distinct peer is located once, however many hosts it meets.
    """
    peers = _listed(
        packets, [], staged_list(hosts), [F.col("peer")], F.count("*").alias("packets")
    )
    places = geo_lookup(peers.select(F.col("peer").alias("ip")), blocks)
    located = peers.join(places.select(F.col("ip").alias("peer"), "country"), "peer", "left")
    return located.groupBy("capture", "ip", "role", "country").agg(F.sum("packets").alias("rate"))
