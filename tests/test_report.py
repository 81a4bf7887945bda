"""The report: header, tables and sinks."""

import json

import pytest
from pyspark.sql import functions as F

from tests.fixtures import SMALL_CAPTURE, capture, rows
from tests.test_geo import cidr
from wiretally.plans.report import build_report
from wiretally.schema import GEO_SCHEMA, REPORT_SCHEMA
from wiretally.sinks import shared_folder, stage, write_report, write_table
from wiretally.sources.packets import union_captures


@pytest.fixture(scope="module")
def blocks(spark):
    return spark.createDataFrame(
        [cidr("10.0.0.0/30", "Here"), cidr("10.0.0.9/32", None, None, None, -3.0)], GEO_SCHEMA
    )


@pytest.fixture(scope="module")
def packets(spark):
    normal = capture(spark, "10.0.0.5,10.0.0.6,10,TCP,6,50\n", "normal")
    return union_captures([capture(spark, SMALL_CAPTURE), normal])


@pytest.fixture(scope="module")
def report(packets, blocks):
    return build_report(packets, blocks, run_id="r1")


def test_document_shape(report):
    header = report.header
    assert [f.name for f in header.schema] == REPORT_SCHEMA.fieldNames()
    assert [f.dataType.simpleString() for f in header.schema] == [
        f.dataType.simpleString() for f in REPORT_SCHEMA
    ]
    assert header.count() == 1


def test_document_contents(report):
    document = json.loads(report.header.select(F.to_json(F.struct("*"))).first()[0])
    assert (document["run_id"], document["user"]) == ("r1", "NA")
    assert document["AveragePacketRate"] == {
        "normal_Average": 1.0, "attack_Average": 2.0,
        "normal_min": 1, "attack_min": 2, "normal_max": 1, "attack_max": 2,
    }
    assert document["AveragePacketData"]["attack_Average"] == 126.0
    # Protocols that do not occur are absent and not counted.
    assert document["ProtocolDistribution"] == {
        "normal": {"TCP": 1, "x": 1},
        "attack": {"TCP": 1, "ICMP": 3, "UDP": 1, "others": 1, "x": 4},
    }
    behaviour = document["BehaviorOfTopIP"]
    assert [p["IP"] for p in behaviour["attackBehaviorOfSource"]] == [
        "10.0.0.1", "10.0.0.2", "10.0.0.9",
    ]
    assert [p["IP"] for p in behaviour["normalBehaviorOfDestination"]] == ["10.0.0.6"]
    first, second, third = behaviour["attackBehaviorOfSource"]
    # Each role has its own first and last packet.
    assert first == {
        "IP": "10.0.0.1",
        "Source": {
            "PacketNumber": 3, "sendData": 160,
            "FirstConnection": "01-01-1970 00:01:40", "LastConnection": "01-01-1970 00:01:41",
            "Country": {"name": "Here"}, "Hours": [{"Hour": 0, "rate": 3}],
        },
        "Destination": {
            "PacketNumber": 1, "receiveData": 88,
            "FirstConnection": "01-01-1970 00:01:43", "LastConnection": "01-01-1970 00:01:43",
            "Country": {"name": "Here"}, "Hours": [{"Hour": 0, "rate": 1}],
        },
    }
    # A host never seen as a destination.
    assert second["Destination"] == {
        "PacketNumber": 0, "receiveData": 0, "Country": {"name": "Here"}, "Hours": [],
    }
    assert third["Source"]["Country"] == {}
    assert document["Map"] == {
        "attackDS": [
            {"source": "10.0.0.1", "destination": "10.0.0.9", "value": 0},
            {"source": "10.0.0.2", "destination": "10.0.0.9", "value": 50},
            {"source": "10.0.0.9", "destination": "10.0.0.1", "value": 100},
        ],
        "normalDS": [{"source": "10.0.0.5", "destination": "10.0.0.6", "value": 0}],
        "victimData": [
            {"destination": "10.0.0.9", "value": 0},
            {"destination": "10.0.0.9", "value": 50},
            {"destination": "10.0.0.1", "value": 100},
        ],
    }


def test_tables_of_the_report(report):
    series = ["capture", "idx", "second", "packets", "bytes", "TCP", "ICMP", "others"]
    assert rows(report.series, *series) == [
        ("attack", 0, 100, 2, 120, 0, 2, 0),
        ("attack", 1, 101, 2, 100, 1, 0, 0),
        ("attack", 2, 103, 2, 158, 0, 1, 1),
        ("normal", 0, 50, 1, 10, 1, 0, 0),
    ]
    places = {r["ip"]: (r["longitude"], r["latitude"]) for r in report.locations.collect()}
    assert places == {
        "10.0.0.1": (2.0, 1.0), "10.0.0.2": (2.0, 1.0), "10.0.0.5": (0.0, 0.0),
        "10.0.0.6": (0.0, 0.0), "10.0.0.9": (-3.0, None),
    }
    of_first = report.protocols.where("ip = '10.0.0.1'")
    assert rows(of_first, "capture", "role", "Name", "rate") == [
        ("attack", "dst", "ICMP", 1), ("attack", "src", "ICMP", 2), ("attack", "src", "TCP", 1),
    ]
    assert all(set(rows(df, "run_id")) == {("r1",)} for df in report)


def test_other_capture_names_are_an_error(spark, blocks):
    for name in ("third", None):
        odd = capture(spark, SMALL_CAPTURE).withColumn("capture", F.lit(name).cast("string"))
        with pytest.raises(ValueError, match="captures"):
            build_report(odd, blocks)


def test_report_sink_appends_and_table_sink_replaces(spark, report, tmp_path):
    for _ in range(2):
        write_report(report, str(tmp_path / "documents"))
    for name, n in (("header", 1), ("series", 4), ("locations", 5)):
        stored = spark.read.json(str(tmp_path / "documents" / name))
        assert rows(stored, "run_id") == [("r1",)] * 2 * n
    table = spark.range(3)
    for fmt in ("parquet", "json"):
        for _ in range(2):
            write_table(table, str(tmp_path / fmt), fmt)
        assert spark.read.format(fmt).load(str(tmp_path / fmt)).count() == 3


def test_staged_tables_go_to_the_shared_folder(spark, tmp_path):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    staged = stage(spark.range(5), str(tmp_path), "five")
    assert staged.inputFiles() and all(str(tmp_path) in f for f in staged.inputFiles())
    assert stage(staged, None, "five") is staged


def test_captures_may_be_missing(spark, blocks):
    only = build_report(capture(spark, SMALL_CAPTURE), blocks)
    row = only.header.first()
    assert row["AveragePacketRate"]["normal_Average"] is None and row["Map"]["normalDS"] == []
    assert row["ProtocolDistribution"]["normal"]["x"] == 0
    assert len(row["Map"]["attackDS"]) == 3


def test_empty_captures_give_an_empty_report(spark, blocks):
    empty = build_report(capture(spark, "no packets here\n"), blocks)
    row = empty.header.first()
    assert row["AveragePacketRate"]["attack_Average"] is None
    assert row["BehaviorOfTopIP"]["attackBehaviorOfSource"] == row["Map"]["victimData"] == []
    assert [df.count() for df in empty] == [1, 0, 0, 0]
