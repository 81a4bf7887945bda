import random

import pytest

from tests.fixtures import capture, rows
from wiretally.operators import geo
from wiretally.schema import GEO_SCHEMA
from wiretally.sources.geo import conform_blocks, read_geo_blocks, read_network_locations


def text(value):
    return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))


def number(ip):
    a, b, c, d = map(int, ip.split("."))
    return a << 24 | b << 16 | c << 8 | d


def cidr(network, country, city="c", latitude=1.0, longitude=2.0):
    base, length = network.split("/")
    start = number(base)
    return (start, start + 2 ** (32 - int(length)) - 1, int(length), country, city, latitude, longitude)


def countries(spark, blocks, ips):
    table = spark.createDataFrame([(i,) for i in ips], "ip string")
    block_table = spark.createDataFrame(blocks, GEO_SCHEMA)
    return dict(rows(geo.geo_lookup(table, block_table), "ip", "country"))


def test_most_specific_block_wins_and_wide_ones_reach_beyond_it(spark):
    blocks = [
        cidr("0.0.0.0/0", "world"),
        cidr("10.0.0.0/8", "eight"),
        cidr("10.1.0.0/16", "sixteen"),
        cidr("10.1.2.0/23", "twenty-three"),
        cidr("10.1.2.128/25", "twenty-five"),
        cidr("10.1.2.129/32", "one"),
    ]
    expected = {
        "10.1.2.129": "one",
        "10.1.2.130": "twenty-five",
        "10.1.2.1": "twenty-three",
        "10.1.3.255": "twenty-three",
        "10.1.4.0": "sixteen",
        "10.255.255.255": "eight",
        "11.0.0.0": "world",
        "255.255.255.255": "world",
        "0.0.0.0": "world",
        "": "not found",
        "10.1.2": "not found",
        "999.1.1.1": "not found",
    }
    assert countries(spark, blocks, expected) == expected


def test_declared_prefix_length_decides_between_equal_ranges(spark):
    start = number("10.0.0.0")
    blocks = [
        (start, start + 7, 29, "longer", "c", 1.0, 2.0),
        (start, start + 7, 20, "shorter", "c", 1.0, 2.0),
        (start, start + 3, 24, "inner, yet shorter", "c", 1.0, 2.0),
    ]
    assert countries(spark, blocks, ["10.0.0.1"]) == {"10.0.0.1": "longer"}


def test_found_attributes_may_be_null_but_missing_ones_have_defaults(spark):
    blocks = spark.createDataFrame([cidr("10.0.0.0/24", None, None, None, -1.5)], GEO_SCHEMA)
    packets = capture(spark, "10.0.0.1,10.9.0.1,60,TCP,6,1\n,10.0.0.1,60,ARP,,1\n")
    assert sorted(map(str, geo.geo_lookup(geo.distinct_ips(packets), blocks).collect())) == sorted(
        [
            "Row(ip='', found=False, country='not found', city='not found', latitude=0.0, longitude=0.0)",
            "Row(ip='10.0.0.1', found=True, country=None, city=None, latitude=None, longitude=-1.5)",
            "Row(ip='10.9.0.1', found=False, country='not found', city='not found', latitude=0.0, longitude=0.0)",
        ]
    )
    assert geo.all_endpoints(packets).count() == 4
    assert geo.geo_map(packets, blocks).count() == 3


@pytest.mark.parametrize("seed", range(4))
def test_arbitrary_ranges_against_brute_force(spark, seed):
    rng = random.Random(seed)
    blocks = []
    for i in range(120):
        width = int(2 ** rng.uniform(0, 20))
        start = rng.randrange(number("10.0.0.0"), number("10.40.0.0"))
        blocks.append((start, start + width - 1, rng.randrange(8, 33), f"b{i}", "c", 1.0, 2.0))
    blocks += [(5, 4, 32, "reversed", "c", 1.0, 2.0), (-1, 3, 32, "negative", "c", 1.0, 2.0)]
    ips = [text(rng.randrange(number("9.255.0.0"), number("10.41.0.0"))) for _ in range(400)]
    ips += [text(b[0]) for b in blocks[:120]] + [text(b[1]) for b in blocks[:120]] + ["0.0.0.2"]

    def brute(ip):
        hits = [b for b in blocks[:120] if b[0] <= number(ip) <= b[1]]
        best = max(hits, key=lambda b: (b[2], b[0] - b[1], -b[0]), default=None)
        return best[3] if best else "not found"

    assert countries(spark, blocks, ips) == {ip: brute(ip) for ip in ips}


def test_pieces_cover_each_block_exactly_once(spark):
    blocks = [
        (0, 2**32 - 1, 0, "all", "c", 1.0, 2.0),
    ]
    table = spark.createDataFrame(blocks, GEO_SCHEMA)
    assert geo.block_pieces(table).count() == 2**16
    odd = spark.createDataFrame([(65_530, 200_001, 1, "x", "c", 1.0, 2.0)], GEO_SCHEMA)
    keys = [r["piece"] for r in geo.block_pieces(odd).collect()]
    covered = []
    for key in keys:
        level, unit = key >> 32, key & (2**32 - 1)
        size = 2 ** (32 - level)
        covered += range(unit * size, (unit + 1) * size)
    assert sorted(covered) == list(range(65_530, 200_002))


def test_copies_of_one_range_count_once(spark):
    blocks = [cidr("10.0.0.0/16", f"copy {i % 3}") for i in range(3000)]
    table = spark.createDataFrame(blocks, GEO_SCHEMA)
    assert geo.block_pieces(table).count() == 1
    assert countries(spark, blocks, ["10.0.3.4"]) == {"10.0.3.4": "copy 2"}


def test_lookup_is_an_equality_join(spark):
    big = spark.range(10).selectExpr("concat('10.0.0.', id) as ip")
    blocks = spark.createDataFrame([cidr("10.0.0.0/24", "x")], GEO_SCHEMA)
    plan = geo.geo_lookup(big, blocks)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_recorded_locations(spark):
    # Coordinates of three addresses in a recorded report.
    recorded = {
        "192.95.27.190": (45.504, -73.5747),
        "202.1.175.252": (-9.4333, 159.95),
        "71.126.222.64": (38.0, -97.0),
    }
    blocks = spark.createDataFrame(
        [cidr(f"{ip}/32", "c", "c", *place) for ip, place in recorded.items()], GEO_SCHEMA
    )
    packets = capture(spark, "".join(f"{ip},71.126.222.64,60,ICMP,1,1\n" for ip in recorded))
    places = geo.geo_map(packets, blocks)
    assert {r["ip"]: (r["latitude"], r["longitude"]) for r in places.collect()} == recorded


def test_top_countries(spark):
    blocks = spark.createDataFrame(
        [cidr("10.0.0.0/24", "A"), cidr("10.0.1.0/24", "B")], GEO_SCHEMA
    )
    packets = capture(
        spark, "10.0.0.1,x,1,TCP,6,1\n10.0.0.2,x,1,TCP,6,1\n10.0.1.1,x,1,TCP,6,1\ny,x,1,TCP,6,1\n"
    )
    assert rows(geo.top_countries(packets, blocks)) == [
        ("attack", 1, "A", 2), ("attack", 2, "B", 1), ("attack", 3, "not found", 1),
    ]
    assert rows(geo.top_countries(packets, blocks, role="dst")) == [("attack", 1, "not found", 4)]


def test_block_sources(spark, tmp_path):
    (tmp_path / "blocks.csv").write_text(
        "network,geoname_id,latitude,longitude\n"
        "10.0.0.0/24,1,1.5,2.5\n10.0.1.7/24,2,,\nbad,1,0,0\n10.0.0.0/40,1,0,0\n2001:db8::/32,1,0,0\n"
    )
    (tmp_path / "places.csv").write_text(
        "geoname_id,country_name,city_name\n1,Land,Town\n2,Other,\n"
    )
    table = read_network_locations(
        spark, str(tmp_path / "blocks.csv"), str(tmp_path / "places.csv")
    )
    first = number("10.0.0.0")
    assert rows(table) == [
        (first, first + 255, 24, "Land", "Town", 1.5, 2.5),
        (first + 256, first + 511, 24, "Other", None, None, None),
    ]
    table.write.parquet(str(tmp_path / "geo"))
    assert rows(read_geo_blocks(spark, str(tmp_path / "geo")), "country") == [("Land",), ("Other",)]
    ranges = spark.createDataFrame([(first, first + 5, "L")], "ip_from long, ip_to long, country string")
    assert rows(conform_blocks(ranges), "prefix_len", "country", "city") == [(29, "L", None)]
    (tmp_path / "r.csv").write_text(f"ip_from,ip_to,country\n{first},{first},L\n")
    assert rows(read_geo_blocks(spark, str(tmp_path / "r.csv"), "csv"), "ip_to", "prefix_len") == [(first, 32)]


def test_kept_pieces_locate_as_their_blocks_without_being_shuffled(spark, tmp_path):
    rng = random.Random(5)
    blocks = []
    for i in range(300):
        length = rng.choice([8, 13, 16, 19, 24, 27, 32])
        blocks.append(cidr(f"{text(rng.choice([167772160, 0, 4278190080]) + rng.randrange(2**20))}/{length}", str(i)))
    table = spark.createDataFrame(blocks, GEO_SCHEMA)
    ips = spark.createDataFrame(
        [(text(rng.choice([167772160, 0, 4278190080]) + rng.randrange(2**20)),) for _ in range(2000)]
        + [("",), (None,), ("x",), ("255.255.255.255",)],
        "ip string",
    )
    geo.keep_pieces(table, "kept_pieces", str(tmp_path / "pieces"), buckets=7)
    kept = geo.kept_pieces(spark, "kept_pieces")
    assert kept.buckets == 7
    located = geo.geo_lookup(ips, kept)
    assert sorted(map(repr, located.collect())) == sorted(map(repr, geo.geo_lookup(ips, table).collect()))
    plan = geo.locate(ips, kept)._jdf.queryExecution().executedPlan().toString()
    # The addresses alone are shuffled; the buckets are read as they lie.
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
    assert plan.index("Union") < plan.index("Exchange")
    # Written again, with other blocks.
    geo.keep_pieces(table.limit(0), "kept_pieces", str(tmp_path / "pieces"), buckets=3)
    empty = geo.geo_lookup(ips, geo.kept_pieces(spark, "kept_pieces"))
    assert empty.where("found").count() == 0 and empty.count() == located.count()
    table.write.option("path", str(tmp_path / "plain")).saveAsTable("plain_blocks")
    with pytest.raises(ValueError):
        geo.kept_pieces(spark, "plain_blocks")
