"""The values of a report as rows, one per value."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

from wiretally.functions.columns import ip_to_long
from wiretally.plans.report import Report
from wiretally.schema import BUCKETS, CAPTURES

_ROLE = "if(role = 'src', 'Source', 'Destination')"


def report_values(report: Report) -> DataFrame:
    """``(section, position, label, number, text)`` of every report value.

    ``section`` is the path in the report and ``position`` the place in the list
    at that path: the index of a second, the number of an address (-1 for other
    text), 0 for what has no order. Absent values give no row.
    """
    header = ", ".join(_entries())
    series = [
        _row(f"concat('{block}.', capture, '_{name}')", "idx", "null", number)
        for block, metric in (("AveragePacketRate", "packets"), ("AveragePacketData", "bytes"))
        for name, number in (("X", "idx"), ("Y", metric))
    ] + [
        _row(f"concat('AverageProtocolRate.', capture, '.{name}')", "idx", "null", number)
        for name, number in (*((b, b) for b in BUCKETS), ("X", "idx"), ("second", "second"))
    ]
    places = [
        _row(f"'Map.geoData.{name}'", "coalesce(address, -1)", "ip", name)
        for name in ("longitude", "latitude")
    ]
    protocols = _row(
        f"concat('BehaviorOfTopIP.', capture, '.', {_ROLE}, '.Protocols')",
        "0",
        "concat(ip, ' ', Name)",
        "rate",
    )
    located = report.locations.withColumn("address", ip_to_long())
    return (
        report.header.selectExpr(f"inline(concat({header}))")
        .unionByName(report.series.selectExpr(f"inline(array({', '.join(series)}))"))
        .unionByName(located.selectExpr(f"inline(array({', '.join(places)}))"))
        .unionByName(report.protocols.selectExpr(f"inline(array({protocols}))"))
        .where("number is not null or text is not null")
    )


def _row(section: str, position: str, label: str, number: str, text: str = "null") -> str:
    return (
        f"named_struct('section', {section}, 'position', cast({position} as bigint),"
        f" 'label', cast({label} as string), 'number', round(cast({number} as double), 6),"
        f" 'text', cast({text} as string))"
    )


def _items(
    section: str, array: str, number: str = "null", label: str = "null", text: str = "null"
) -> str:
    """SQL for one entry per element ``e`` at position ``i`` of ``array``."""
    return f"transform({array}, (e, i) -> {_row(f"'{section}'", 'i', label, number, text)})"


def _entries() -> Iterator[str]:
    for block in ("AveragePacketRate", "AveragePacketData"):
        for c in CAPTURES:
            for name in ("Average", "min", "max"):
                path = f"{block}.{c}_{name}"
                yield _items(path, f"array({path})", "e")
    for c in CAPTURES:
        for name in (*BUCKETS, "x"):
            path = f"ProtocolDistribution.{c}.{name}"
            yield _items(path, f"array({path})", "e")
        for listed in ("Source", "Destination"):
            yield from _profile_entries(f"BehaviorOfTopIP.{c}BehaviorOf{listed}")
        path = f"Map.{c}DS"
        yield _items(path, path, "e.value", "concat(e.source, ' ', e.destination)")
    yield _items("Map.victimData", "Map.victimData", "e.value", "e.destination")


def _profile_entries(path: str) -> Iterator[str]:
    for role, data in (("Source", "sendData"), ("Destination", "receiveData")):
        for field in ("PacketNumber", data):
            yield _items(f"{path}.{role}.{field}", path, f"e.{role}.{field}", "e.IP")
        for field in ("FirstConnection", "LastConnection"):
            yield _items(
                f"{path}.{role}.{field}", path, label="e.IP", text=f"e.{role}.{field}"
            )
        yield _items(
            f"{path}.{role}.Country", path, label="e.IP", text=f"e.{role}.Country.name"
        )
        # A profile's hours keep the profile's own position.
        entry = _row(f"'{path}.{role}.Hours'", "i", "concat(e.IP, ' ', h.Hour)", "h.rate")
        yield f"flatten(transform({path}, (e, i) -> transform(e.{role}.Hours, h -> {entry})))"
