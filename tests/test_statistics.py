"""The operators on the hand-made capture."""

import pytest
from pyspark.sql import functions as F

from tests.fixtures import SMALL_CAPTURE, capture, rows
from wiretally.operators import hosts, pairs, rates, talkers
from wiretally.sources.packets import union_captures

A = "attack"


@pytest.fixture(scope="module")
def packets(spark):
    return capture(spark, SMALL_CAPTURE).cache()


def test_host_totals(packets):
    assert rows(talkers.host_counts(packets, "src")) == [
        (A, "10.0.0.1", 3), (A, "10.0.0.2", 2), (A, "10.0.0.9", 1),
    ]
    assert rows(talkers.host_counts(packets, "dst")) == [(A, "10.0.0.1", 1), (A, "10.0.0.9", 5)]
    assert rows(talkers.host_bytes(packets, "src")) == [
        (A, "10.0.0.1", 160), (A, "10.0.0.2", 130), (A, "10.0.0.9", 88),
    ]
    assert rows(talkers.host_bytes(packets, "dst")) == [(A, "10.0.0.1", 88), (A, "10.0.0.9", 290)]
    assert rows(rates.total_bytes(packets)) == [(A, 378)]
    with pytest.raises(ValueError):
        talkers.host_counts(packets, "peer")


def test_protocol_mix(packets):
    assert rows(rates.protocol_distribution(packets)) == [
        (A, "ICMP", 3, 4), (A, "TCP", 1, 4), (A, "UDP", 1, 4), (A, "others", 1, 4),
    ]
    (row,) = rates.protocol_map(packets).collect()
    assert row["protocols"] == {"x": 4, "ICMP": 3, "TCP": 1, "UDP": 1, "others": 1}


def test_rates_leave_idle_seconds_out(packets):
    assert rows(rates.packets_per_second(packets)) == [
        (A, 100, 0, 2), (A, 101, 1, 2), (A, 103, 2, 2),
    ]
    assert rows(rates.bytes_per_second(packets), "second", "value") == [
        (100, 120), (101, 100), (103, 158),
    ]
    assert rows(rates.rate_summary(packets)) == [(A, 2.0, 2, 2)]
    assert rows(rates.rate_summary(packets, "bytes")) == [(A, 126.0, 100, 158)]
    assert rows(rates.packets_per_second(packets, 2)) == [(A, 100, 0, 4), (A, 102, 1, 2)]


def test_protocols_per_second_have_zeros(packets):
    assert rows(rates.protocol_per_second(packets)) == [
        (A, 100, 0, 0, 0, 2, 0, 0),
        (A, 101, 1, 0, 1, 0, 1, 0),
        (A, 103, 2, 0, 0, 1, 0, 1),
    ]


def test_pairs_scale_from_busiest_to_quietest(packets):
    assert rows(pairs.top_pairs(packets)) == [
        (A, 1, "10.0.0.1", "10.0.0.9", 3, 0),
        (A, 2, "10.0.0.2", "10.0.0.9", 2, 50),
        (A, 3, "10.0.0.9", "10.0.0.1", 1, 100),
    ]
    # The range is that of all pairs, also when fewer are listed.
    assert rows(pairs.top_pairs(packets, k=2), "value") == [(0,), (50,)]
    assert rows(pairs.top_victims(packets)) == [
        (1, "10.0.0.9", 0), (2, "10.0.0.9", 50), (3, "10.0.0.1", 100),
    ]


def test_equally_busy_pairs_all_have_the_value_of_the_busiest(spark):
    even = capture(spark, "a,b,1,TCP,6,1\nc,d,1,TCP,6,1\n")
    assert rows(pairs.top_pairs(even), "src", "value") == [("a", 0), ("c", 0)]


def test_known_pair_values_of_a_recorded_flood(spark):
    # Packets of a pair and its value in a recorded report; the quietest had 1.
    known = {
        23099: 0, 19044: 17, 18889: 18, 18477: 20, 17843: 22, 3707: 83, 2222: 90, 349: 98,
        301: 98, 300: 98, 297: 98, 244: 98, 1: 100,
    }
    table = spark.createDataFrame([(A, str(n), "v", n) for n in known], "capture string, src string, dst string, n long")
    assert {r["n"]: r["value"] for r in pairs.top_pairs_of(table).collect()} == known


def test_captures_are_kept_apart(spark, packets):
    other = capture(spark, "x,y,5,TCP,6,7\n", "normal")
    both = union_captures([packets, other])
    assert rows(pairs.top_pairs(both).where("capture = 'normal'")) == [("normal", 1, "x", "y", 1, 0)]
    assert rows(rates.total_bytes(both)) == [(A, 378), ("normal", 5)]
    assert rows(pairs.top_victims(both), "dst") == [("10.0.0.1",), ("10.0.0.9",), ("10.0.0.9",)]


def test_ties_are_broken_by_address(spark):
    tied = capture(spark, "".join(f"10.0.0.{i},v,1,TCP,6,1\n" for i in (3, 1, 2)))
    assert rows(talkers.top_hosts(tied, "src", k=2), "rank", "ip") == [
        (1, "10.0.0.1"), (2, "10.0.0.2"),
    ]


def test_talkers_as_array(packets):
    (row,) = talkers.top_talkers_array(talkers.top_hosts(packets, "src", k=2)).collect()
    assert row["hosts"] == [{"10.0.0.1": 3}, {"10.0.0.2": 2}]


@pytest.fixture(params=["-1", "10485760"])
def list_joins(spark, request):
    """A list that is joined by a shuffle, and one that is broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", request.param)
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_profiles_in_both_roles(spark, packets, list_joins):
    listed = talkers.top_hosts(packets, "src", k=2).withColumn("listed_as", F.lit("src"))
    blocks = spark.createDataFrame(
        [(167772161, 167772161, 32, "Here", None, 1.0, 2.0)],
        "ip_from long, ip_to long, prefix_len int, country string, city string,"
        " latitude double, longitude double",
    )
    assert sorted(map(tuple, hosts.host_profile(packets, listed, blocks).collect())) == [
        (A, "src", 1, "10.0.0.1", "dst", 1, 88, 103.0, 103.0, "Here"),
        (A, "src", 1, "10.0.0.1", "src", 3, 160, 100.1, 101.0, "Here"),
        # Never a destination: zeros and no times.
        (A, "src", 2, "10.0.0.2", "dst", 0, 0, None, None, "not found"),
        (A, "src", 2, "10.0.0.2", "src", 2, 130, 101.5, 103.2, "not found"),
    ]
    assert rows(hosts.host_protocols(packets, listed)) == [
        (A, "10.0.0.1", "dst", "ICMP", 1),
        (A, "10.0.0.1", "src", "ICMP", 2),
        (A, "10.0.0.1", "src", "TCP", 1),
        (A, "10.0.0.2", "src", "DNS", 1),
        (A, "10.0.0.2", "src", "UDP", 1),
    ]
    assert rows(hosts.host_packets(packets, listed)) == [
        (A, "10.0.0.1", "dst", 1), (A, "10.0.0.1", "src", 3), (A, "10.0.0.2", "src", 2),
    ]
    assert rows(hosts.host_peer_countries(packets, listed, blocks)) == [
        (A, "10.0.0.1", "dst", "not found", 1),
        (A, "10.0.0.1", "src", "not found", 3),
        (A, "10.0.0.2", "src", "not found", 2),
    ]
    assert rows(hosts.host_hours(packets, listed, "Asia/Kolkata"), "role", "hour", "rate") == [
        ("dst", 5, 1), ("src", 5, 2), ("src", 5, 3),
    ]


def test_totals_agree_with_each_other(packets):
    total = rates.total_bytes(packets).first()["total"]
    for role in ("src", "dst"):
        assert talkers.host_bytes(packets, role).agg(F.sum("n")).first()[0] == total
    per_second = rates.traffic_per_bucket(packets).agg(
        F.sum("packets"), F.sum("bytes"), F.sum(F.expr("HTTP + TCP + ICMP + UDP + others"))
    )
    assert tuple(per_second.first()) == (packets.count(), total, packets.count())
