import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from tests.fixtures import rows
from wiretally.functions.columns import ipv6_halves
from wiretally.operators import geo, geo6
from wiretally.schema import GEO_SCHEMA, NETWORK6_SCHEMA
from wiretally.sources.geo import conform_networks6, count_block_rejects


def signed(value):
    return value - 2**64 if value >= 2**63 else value


def halves(address):
    value = int(ipaddress.IPv6Address(address))
    return signed(value >> 64), signed(value & 2**64 - 1)


def networks_of(spark, table):
    text = spark.createDataFrame([(n, c) for n, c in table], "network string, country string")
    return conform_networks6(text)


def countries(spark, table, ips, blocks=()):
    addresses = spark.createDataFrame([(i,) for i in ips], "ip string")
    four = spark.createDataFrame(list(blocks), GEO_SCHEMA)
    return dict(rows(geo.geo_lookup(addresses, four, networks_of(spark, table)), "ip", "country"))


def test_address_text_against_the_standard_library(spark):
    rng = random.Random(3)
    texts = [
        "::", "::1", "1::", "1::8", "2001:db8::1", "2001:DB8:0:0:0:0:0:1", "1:2:3:4:5:6:7:8", "::ffff:1.2.3.4",
        "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff",
        "", ":", ":::", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1::2::3", "g::", "12345::", "1.2.3.4", "::1.2.3",
        "::1.2.3.256", "1:2:3:4:5:6:7:1.2.3.4", "fe80::1%eth0", " ::1", "::1\n", "1:2:3:4::5:6:7:8", "1:::2",
    ]
    for _ in range(400):
        texts.append(str(ipaddress.IPv6Address(rng.getrandbits(128) & rng.getrandbits(128) & -(1 << rng.randrange(128)))))
        texts.append("".join(rng.choices("0123456789abcf::::.", k=rng.randint(2, 24))))
    frame = spark.createDataFrame([(t,) for t in texts], "ip string").select("ip", ipv6_halves().alias("h"))
    for row in frame.collect():
        try:
            # The library also takes a zone name.
            want = halves(row["ip"]) if "%" not in row["ip"] else None
        except ValueError:
            want = None
        assert (row["h"] and tuple(row["h"])) == want, row["ip"]


def test_longest_network_wins_and_wide_ones_reach_beyond_it(spark):
    table = [
        ("::/0", "all"), ("2001:db8::/32", "32"), ("2001:db8:1::/46", "46"), ("2001:db8:1:2::/64", "64"),
        ("2001:db8:1:2::8000:0/97", "97"), ("2001:db8:1:2::8000:1/128", "128"), ("8000::/1", "upper half"),
        ("2001:db8:1:2:8000::/65", "upper hosts"),
    ]
    expected = {
        "2001:db8:1:2::8000:1": "128", "2001:db8:1:2::8000:2": "97", "2001:db8:1:2::1": "64",
        "2001:db8:1:2:ffff::": "upper hosts", "2001:db8:1:3::1": "46", "2001:db8:4::": "32", "2001:db9::": "all",
        "ffff::": "upper half", "7fff::": "all", "::2": "all", "1.2.3.4": "not found", "nowhere": "not found", "": "not found",
        "::ffff:9.9.9.9": "four", "9.9.9.9": "four", "::ffff:9.9.8.9": "not found",
    }
    four = [(0x09090900, 0x090909FF, 24, "four", None, 1.0, 2.0)]
    assert countries(spark, table, expected, four) == expected


@pytest.mark.parametrize("seed, lanes", [(0, 1), (1, 7), (2, 40)])
def test_random_networks_against_brute_force(spark, seed, lanes):
    rng = random.Random(seed)
    base = int(ipaddress.IPv6Address("2001:db8::"))
    table, seen = [], []
    for i in range(150):
        length = rng.choice([rng.randint(20, 64), rng.randint(33, 50), rng.randint(64, 128)])
        start = (base ^ rng.getrandbits(96) >> rng.randrange(90)) >> (128 - length) << (128 - length)
        seen.append((ipaddress.IPv6Network((start, length)), f"n{i:03d}"))
        table.append((str(seen[-1][0]), f"n{i:03d}"))
    values = [int(n.network_address) + rng.getrandbits(128 - n.prefixlen) for n, _ in seen for _ in range(2)]
    values += [base ^ rng.getrandbits(96) for _ in range(100)] + [int(n.broadcast_address) for n, _ in seen]
    ips = sorted({str(ipaddress.IPv6Address(v)) for v in values})

    def brute(ip):
        hits = [(n.prefixlen, c) for n, c in seen if ipaddress.IPv6Address(ip) in n]
        return max(hits)[1] if hits else "not found"

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(lanes))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert countries(spark, table, ips) == {ip: brute(ip) for ip in ips}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_pieces_are_few_and_cover_their_network(spark):
    networks = networks_of(spark, [("2001:db8::/29", "a"), ("2001:db8::/29", "b"), ("2001:db8::/65", "c"), ("::/14", "d")])
    counts = dict(rows(geo6.network_pieces(networks).groupBy("level").agg(F.count("*").alias("n"))))
    assert counts == {32: 8, 72: 128, 16: 4}
    assert {r["hit"]["country"] for r in geo6.network_pieces(networks).where("level = 32").collect()} == {"b"}


def test_a_hot_prefix_is_split_and_nothing_is_joined_pairwise(spark):
    hot = spark.range(20_000).selectExpr("concat('2001:db8:0:1::', lower(hex(id % 60000))) as ip")
    networks = networks_of(spark, [("2001:db8::/32", "hot")])
    staged = []
    original = geo6.stage

    def keep(df, folder, name):
        staged.append(original(df, folder, name))
        return staged[-1]

    geo6.stage = keep
    # Small lanes would be merged.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = geo.geo_lookup(hot, spark.createDataFrame([], GEO_SCHEMA), networks)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert found.where("country = 'hot'").count() == 20_000
    finally:
        geo6.stage = original
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    # One prefix, several lanes.
    sizes = [r["count"] for r in staged[0].where("row is not null").groupBy("lane").count().collect()]
    assert len(sizes) > 2 and max(sizes) < 10_000
    assert not any(word in plan for word in ("NestedLoop", "Cartesian", "Python", "SinglePartition"))


def test_networks_of_both_families_are_no_rejects(spark):
    table = spark.createDataFrame(
        [("10.0.0.0/8",), ("2001:db8::/32",), ("::/0",), ("2001:db8::/129",), ("2001:db8::",), ("x/3",), (None,)], "network string"
    )
    assert rows(count_block_rejects(table)) == [("network", 4)]
    got = rows(conform_networks6(table.where("network = '2001:db8::/32'")), "hi", "lo", "prefix_len")
    assert got == [(*halves("2001:db8::"), 32)]
    assert conform_networks6(table).schema == NETWORK6_SCHEMA
    # Bits beyond the prefix are cleared.
    loose = spark.createDataFrame([("2001:db8::ff/64",)], "network string")
    assert rows(conform_networks6(loose), "hi", "lo") == [halves("2001:db8::")]
