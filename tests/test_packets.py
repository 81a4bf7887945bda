from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tests.fixtures import SMALL_CAPTURE, capture, lines, rows
from wiretally.functions.columns import (
    epoch_second,
    ip_to_long,
    number,
    protocol_bucket,
    readable_time,
    time_bucket,
)
from wiretally.operators import rates, talkers
from wiretally.schema import PACKET_SCHEMA
from wiretally.sources import packets as source


def test_reads_two_labelled_files_and_drops_wrong_arity(spark, tmp_path):
    (tmp_path / "n.csv").write_text(SMALL_CAPTURE)
    (tmp_path / "a.csv").write_bytes(SMALL_CAPTURE.splitlines()[0].encode() + b"\r\n")
    both = source.read_captures(
        spark, {"normal": str(tmp_path / "n.csv"), "attack": str(tmp_path / "a.csv")}
    )
    assert [f.name for f in both.schema] == PACKET_SCHEMA.fieldNames()
    assert [f.dataType for f in both.schema] == [f.dataType for f in PACKET_SCHEMA]
    assert rows(both.groupBy("capture").count()) == [("attack", 1), ("normal", 6)]
    # The count agrees with the rows whatever columns are read.
    assert both.count() == len(both.collect()) == 7


def test_text_round_trip(spark, tmp_path):
    packets = capture(spark, SMALL_CAPTURE)
    source.write_packet_text(packets, str(tmp_path / "out"))
    again = source.read_packets(spark, str(tmp_path / "out"), "attack")
    assert rows(again) == rows(packets)


def test_blank_addresses_count_unless_dropped(spark):
    text = ",,60,ARP,,3.5\n10.0.0.1,10.0.0.2,60,ARP,,3.5\na,b,,,,\n"
    assert rows(capture(spark, text), "src", "protocol_number") == [("", None), ("10.0.0.1", None)]
    kept = source.parse_lines(lines(spark, text), "attack", drop_blank_ip=True)
    assert rows(kept, "src") == [("10.0.0.1",)]


def test_unusable_numbers_are_rejected_and_counted(spark):
    text = "\n".join(
        ["a,b,60,TCP,6,1.5", "a,b,60.9,TCP,x,1e2"]
        + [f"a,b,{bad},TCP,6,1" for bad in ("abc", "", "nan", "inf", "1e400", "60d", "0x1p3")]
        + [f"a,b,60,TCP,6,{bad}" for bad in ("noon", "", "Infinity", "1e300", "99999999999999")]
        + ["", "a,b", "a,b,c,d,e,f,g"]
    )
    assert rows(capture(spark, text), "data_length", "arrival_time") == [(60, 1.5), (60, 100.0)]
    assert rows(source.count_rejects(lines(spark, text))) == [
        ("arity", 3),
        ("arrival_time", 5),
        ("data_length", 7),
    ]


def test_conform_fills_null_addresses(spark):
    table = spark.createDataFrame(
        [("attack", None, "b", 5, "TCP", 6, 1.0), ("attack", "a", "b", None, "TCP", 6, 1.0)],
        PACKET_SCHEMA,
    )
    assert rows(source.conform(table), "src", "data_length") == [("", 5)]


def test_parquet_copy_reads_only_needed_columns_and_captures(spark, tmp_path):
    copy = source.write_packets(capture(spark, SMALL_CAPTURE), str(tmp_path / "copy"))
    assert rows(copy) == rows(capture(spark, SMALL_CAPTURE))
    plan = (
        talkers.host_counts(copy.where(F.col("capture") == "attack"), "src")
        ._jdf.queryExecution()
        .executedPlan()
        .toString()
    )
    assert "ReadSchema: struct<src:string>" in plan
    assert "PartitionFilters: [isnotnull(capture" in plan
    filtered = copy.where(F.col("src") == "10.0.0.1")._jdf.queryExecution().executedPlan()
    assert "EqualTo(src,10.0.0.1)" in filtered.toString()


def test_seconds_truncate_toward_zero(spark):
    times = spark.createDataFrame([(-1.5,), (1.9,), (-0.2,)], "arrival_time double")
    assert rows(times.select(epoch_second())) == [(-1,), (0,), (1,)]
    assert rows(times.select(time_bucket(10))) == [(-10,), (0,), (0,)]
    with pytest.raises(ValueError):
        time_bucket(0)


@pytest.mark.parametrize("session_zone", ["UTC", "America/Chicago", "Asia/Kolkata"])
def test_readable_time_ignores_the_session_zone(spark, session_zone):
    spark.conf.set("spark.sql.session.timeZone", session_zone)
    try:
        # The second one falls into a skipped local hour in Chicago.
        seconds = [1186246476, 1173580200, 0, -1]
        for second in seconds:
            expected = datetime.fromtimestamp(second, tz=timezone.utc)
            text = spark.range(1).select(readable_time(F.lit(second).cast("bigint"))).first()[0]
            assert text == expected.strftime("%m-%d-%Y %H:%M:%S")
        local = readable_time(F.lit(1186246476).cast("bigint"), "America/Chicago")
        assert spark.range(1).select(local).first()[0] == "08-04-2007 11:54:36"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_protocol_names_match_exactly(spark):
    names = ["HTTP", "TCP", "ICMP", "UDP", "others", "tcp", "", None, "DNS"]
    table = spark.createDataFrame([(n,) for n in names], "protocol_name string")
    assert [r[0] for r in table.select(protocol_bucket()).collect()] == names[:4] + ["others"] * 5


def test_protocol_named_others_is_counted_in_both_views(spark):
    packets = capture(spark, "a,b,1,others,1,1\na,b,1,tcp,1,1\na,b,1,TCP,1,1\n")
    assert rows(rates.protocol_distribution(packets)) == [
        ("attack", "TCP", 1, 2),
        ("attack", "others", 2, 2),
    ]
    assert rows(rates.protocol_per_second(packets), "TCP", "others") == [(1, 2)]


def test_numbers_and_addresses(spark):
    texts = ["60", " 60 ", "-1.5", "1e3", "", "1f", "NaN", "0x10", None]
    table = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in table.select(number(F.col("t"))).collect()] == [
        60.0, 60.0, -1.5, 1000.0, None, None, None, None, None,
    ]
    ips = {
        "0.0.0.0": 0,
        "255.255.255.255": 2**32 - 1,
        "10.0.1.2": 10 * 2**24 + 258,
        "": None,
        "256.0.0.1": None,
        "1.2.3": None,
        "1.2.3.4.5": None,
        "1.2.3.x": None,
        "01.2.3.4": None,
        "1.2.3.4\n": None,
        "::1": None,
    }
    table = spark.createDataFrame([(i,) for i in ips], "ip string")
    assert [r[0] for r in table.select(ip_to_long()).collect()] == list(ips.values())
