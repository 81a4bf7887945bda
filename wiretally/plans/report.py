"""The report over both captures: one header document and three tables of rows.

Packets are read three times, whatever the number of statistics: once per
second, once per source-destination pair, once for the listed hosts. All
sections start from those three small tables.

What is bounded by the lengths of the lists is nested in the header: one row per
run. What grows with the traffic is always rows, in the same layout for every
size: seconds of the series, located addresses, and protocols of the listed
hosts. All four carry the ``run_id``.
"""

from __future__ import annotations

import uuid
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiretally.functions.columns import readable_time
from wiretally.operators import geo, hosts, pairs, rates, talkers
from wiretally.schema import (
    BUCKETS,
    CAPTURES,
    REPORT_SCHEMA,
    REPORT_USER,
    TOP_HOSTS,
    TOP_PAIRS,
)
from wiretally.sinks import shared_folder, stage


class Report(NamedTuple):
    #: One row of ``REPORT_SCHEMA``.
    header: DataFrame
    #: ``run_id, capture, idx, second, packets, bytes, HTTP .. others``
    series: DataFrame
    #: ``run_id, ip, longitude, latitude``
    locations: DataFrame
    #: ``run_id, capture, ip, role, Name, rate`` of the listed hosts
    protocols: DataFrame


def build_report(
    packets: DataFrame,
    blocks: geo.Blocks,
    run_id: str | None = None,
    hosts_k: int = TOP_HOSTS,
    pairs_k: int = TOP_PAIRS,
    zone: str = "UTC",
    networks6: DataFrame | None = None,
) -> Report:
    """The report, IPv6 addresses located by ``networks6`` if given; captures of another name than ``CAPTURES`` raise ``ValueError``."""
    folder = shared_folder(packets.sparkSession)
    counts = stage(pairs.pair_counts(packets), folder, "pairs")
    _check_captures(counts)
    seconds = stage(rates.with_index(rates.traffic_per_bucket(packets)), folder, "seconds")
    listed = stage(talkers.top_hosts_by_role(counts, hosts_k, "n"), folder, "hosts")
    totals = stage(hosts.role_totals_of(packets, listed, zone), folder, "totals")
    places = stage(geo.geo_lookup(geo.distinct_ips(counts), blocks, networks6), folder, "places")

    sections = [
        _summary(seconds),
        _behaviour(totals, hosts.with_country(listed, places), zone),
        _pairs(pairs.top_pairs_of(counts, pairs_k)),
    ]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sections)
    # One row per section.
    one = rows.agg(*[F.first(c, ignorenulls=True).alias(c) for c in rows.columns])
    run = F.lit(run_id or uuid.uuid4().hex).alias("run_id")
    protocols = hosts.summed_rates(totals, "protocol_name")
    return Report(
        _assemble(one, run),
        seconds.select(run, "capture", "idx", "second", "packets", "bytes", *BUCKETS),
        places.select(run, "ip", "longitude", "latitude"),
        protocols.select(run, "capture", "ip", "role", F.col("protocol_name").alias("Name"), "rate"),
    )


def _check_captures(counts: DataFrame) -> None:
    named = F.coalesce(F.col("capture").isin(*CAPTURES), F.lit(False))
    other = counts.where(~named).select("capture").limit(1).collect()
    if other:
        raise ValueError(f"captures must be named {CAPTURES}, not {other[0]['capture']!r}")


def _gather(condition: str, position: str, *fields: str) -> Column:
    """Array of structs of ``fields`` in order of ``position``, where ``condition`` holds."""
    row = f"struct({', '.join((position, *fields))})"
    return F.expr(f"sort_array(collect_list({row}) filter (where {condition}))")


def _summary(seconds: DataFrame) -> DataFrame:
    """Rate summaries and protocol totals of both captures as one row."""
    columns = []
    for c in CAPTURES:
        only = f"filter (where capture = '{c}')"
        columns += [
            f"{f}({metric}) {only} as {c}_{metric}_{f}"
            for metric in ("packets", "bytes")
            for f in ("avg", "min", "max")
        ]
        columns += [f"nullif(sum({b}) {only}, 0) as {c}_{b}" for b in BUCKETS]
    return seconds.selectExpr(*columns)


def _profile_block(role: str, bytes_name: str, zone: str) -> Column:
    def pick(column: Column | str) -> Column:
        return F.max(F.when(F.col("role") == role, column))

    def time(name: str) -> Column:
        return pick(readable_time(F.col(name).cast("bigint"), zone))

    return F.struct(
        pick(F.col("packets")).alias("PacketNumber"),
        pick(F.col("bytes")).alias(bytes_name),
        time("first_connection").alias("FirstConnection"),
        time("last_connection").alias("LastConnection"),
        F.struct(F.max("country").alias("name")).alias("Country"),
        F.coalesce(pick(F.col("hours")), F.array()).alias("Hours"),
    )


def _behaviour(totals: DataFrame, located: DataFrame, zone: str) -> DataFrame:
    """Profiles of the listed hosts, at most k a list, each with at most 24 hours a role."""
    profiles = hosts.profile_rows(hosts.role_sums(totals), located)
    hours = (
        hosts.summed_rates(totals, "hour")
        .groupBy("capture", "ip", "role")
        .agg(F.expr("sort_array(collect_list(struct(hour as Hour, rate)))").alias("hours"))
    )
    one_per_host = (
        profiles.join(hours, ["capture", "ip", "role"], "left")
        .groupBy("capture", "listed_as", "rank", "ip")
        .agg(
            F.struct(
                F.col("ip").alias("IP"),
                _profile_block("src", "sendData", zone).alias("Source"),
                _profile_block("dst", "receiveData", zone).alias("Destination"),
            ).alias("profile")
        )
    )
    return one_per_host.agg(
        *[
            _gather(f"capture = '{c}' and listed_as = '{r}'", "rank", "profile").alias(
                f"{c}_{r}_profiles"
            )
            for c in CAPTURES
            for r in ("src", "dst")
        ]
    )


def _pairs(top: DataFrame) -> DataFrame:
    """The pair lists, at most k pairs a capture."""
    return top.agg(
        *[
            _gather(f"capture = '{c}'", "rank", "src", "dst", "value").alias(f"{c}_pairs")
            for c in CAPTURES
        ]
    )


def _struct(fields: dict[str, str]) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


def _list(array: str, element: str) -> str:
    """SQL for ``array`` mapped to ``element`` of ``e``; an absent array is empty."""
    return f"coalesce(transform({array}, e -> {element}), array())"


def _rate(metric: str) -> str:
    short = {"Average": "avg", "min": "min", "max": "max"}
    return _struct(
        {f"{c}_{name}": f"{c}_{metric}_{s}" for name, s in short.items() for c in CAPTURES}
    )


def _distribution(c: str) -> str:
    present = " + ".join(f"if({c}_{b} is null, 0, 1)" for b in BUCKETS)
    return _struct({b: f"{c}_{b}" for b in BUCKETS} | {"x": present})


def _assemble(one: DataFrame, run: Column) -> DataFrame:
    pair = _struct({"source": "e.src", "destination": "e.dst", "value": "e.value"})
    victim = _struct({"destination": "e.dst", "value": "e.value"})
    sections = {
        "user": f"'{REPORT_USER}'",
        "AveragePacketRate": _rate("packets"),
        "AveragePacketData": _rate("bytes"),
        "ProtocolDistribution": _struct({c: _distribution(c) for c in CAPTURES}),
        "BehaviorOfTopIP": _struct(
            {
                f"{c}BehaviorOf{role}": _list(f"{c}_{r}_profiles", "e.profile")
                for c in CAPTURES[::-1]
                for r, role in (("src", "Source"), ("dst", "Destination"))
            }
        ),
        "Map": _struct(
            {
                "attackDS": _list("attack_pairs", pair),
                "normalDS": _list("normal_pairs", pair),
                "victimData": _list("attack_pairs", victim),
            }
        ),
    }
    columns = {name: F.expr(sql) for name, sql in sections.items()} | {"run_id": run}
    return one.select(
        *[columns[f.name].cast(f.dataType).alias(f.name) for f in REPORT_SCHEMA.fields]
    )
