"""What the plans must and must not contain."""

import pytest
from pyspark.sql import functions as F

from wiretally.operators import geo, hosts, pairs, rates, talkers
from wiretally.plans import report
from wiretally.plans.catalog import QUERIES
from wiretally.sinks import stage
from wiretally.sources.packets import write_packets
from wiretally.sources.tables import geo_view, packets_view

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def packets(spark, tmp_path_factory):
    return write_packets(packets_view(spark, SF_DIR), str(tmp_path_factory.mktemp("packets") / "p"))


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_and_no_pairwise_joins(spark, name):
    plan = planned(QUERIES[name](spark, SF_DIR))
    for forbidden in ("Python", "Pandas", "NestedLoop", "Cartesian", "ExistingRDD", "SinglePartition"):
        assert forbidden not in plan or (forbidden == "SinglePartition" and name in REPORTS)


# The report's rate summary is one row over a pre-aggregated table.
REPORTS = {"report_values"}


@pytest.mark.parametrize("threshold", ["-1", "10485760"])
@pytest.mark.parametrize(
    "name, scans",
    [("packets_per_second", 1), ("top_pairs", 1), ("top_countries", 1), ("geo_map", 1), ("host_profile", 1)],
)
def test_packets_are_scanned_once_per_pass(spark, packets, threshold, name, scans):
    blocks = geo_view(spark, SF_DIR)
    listed = talkers.top_hosts(packets, "src").withColumn("listed_as", F.lit("src"))
    build = {
        "packets_per_second": lambda: rates.packets_per_second(packets),
        "top_pairs": lambda: pairs.top_pairs(packets),
        "top_countries": lambda: geo.top_countries(packets, blocks),
        "geo_map": lambda: geo.geo_map(packets, blocks),
        "host_profile": lambda: hosts.host_profile(packets, listed, blocks),
    }
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        plan = executed(build[name]())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scanned = [line for line in plan.splitlines() if "FileScan" in line and "r_name" not in line]
    # The host list was made and staged in a pass of its own.
    own = [line for line in scanned if "n_name" not in line and "ip#" not in line]
    assert len(own) == scans


def test_listed_hosts_are_filtered_before_the_shuffle(spark, packets):
    plan = planned(hosts.host_packets(packets, talkers.top_hosts(packets, "src")))
    join, exchange = plan.index("LeftSemi"), plan.index("Exchange hashpartitioning")
    assert exchange < join  # printed top down: the join lies below the shuffle
    assert "BroadcastHashJoin" in plan


def test_long_host_list_is_not_broadcast(spark, packets):
    long = spark.range(1_000_000).select(
        F.lit("normal").alias("capture"), F.md5(F.col("id").cast("string")).alias("ip")
    )
    plan = planned(hosts.host_packets(packets, long))
    semi = [line for line in plan.splitlines() if "LeftSemi" in line]
    assert semi and all("SortMergeJoin" in line for line in semi)
    # Only the filter of the list is broadcast, once for either end.
    assert plan.count("BroadcastHashJoin") == plan.count("LeftOuter, BuildRight") == 2


def test_filter_of_a_long_list_passes_few_other_packets_before_they_are_doubled(spark, packets):
    packets_of = spark.range(200_000).selectExpr(
        "if(id % 2 = 0, 'normal', 'attack') capture", "md5(string(id)) src", "md5(string(-id)) dst"
    )
    # Neither broadcast nor small: every fiftieth source is listed.
    listed = packets_of.where("conv(substr(src, 1, 4), 16, 10) % 50 = 0").selectExpr("capture", "src ip")
    listed = hosts.staged_list(listed)
    passed = hosts.maybe_listed(packets_of, listed)
    assert passed.columns == packets_of.columns
    n = listed.count()
    assert 3000 < n <= passed.count() < n + 0.05 * 200_000
    assert passed.join(listed.withColumnRenamed("ip", "src"), ["capture", "src"], "left_semi").count() == n
    plan = planned(hosts.host_packets(packets_of, listed))
    # Printed top down: doubled after the filter.
    assert plan.index("Generate explode") < plan.index("LeftOuter, BuildRight")


@pytest.mark.parametrize("words", [1, 2, 1 << 17])
def test_filter_never_drops_a_listed_host(spark, monkeypatch, words):
    # Too few words for the list: all bits are set, nothing is dropped, and the join decides.
    monkeypatch.setattr(hosts, "_FILTER_WORDS", words)
    rows = [("attack", f"h{i % 40}" if i % 7 else None, f"h{i % 11}") for i in range(500)]
    packets = spark.createDataFrame(rows, "capture string, src string, dst string")
    for chosen in (["h3", "h39"], [f"h{i}" for i in range(40)], []):
        listed = spark.createDataFrame([("attack", h) for h in chosen], "capture string, ip string")
        assert hosts.filter_words(listed) <= words
        found = {(r["ip"], r["role"]): r["packets"] for r in hosts.host_packets(packets, listed).collect()}
        plain = {}
        for _, src, dst in rows:
            for ip, role in ((src, "src"), (dst, "dst")):
                if ip in chosen:
                    plain[ip, role] = plain.get((ip, role), 0) + 1
        assert found == plain


def test_filters_merge(spark):
    listed = spark.range(1000).selectExpr("'attack' capture", "string(id) ip")
    parts = [hosts.host_filter(listed.where(f"ip % 2 = {i}"), 64) for i in (0, 1)]
    merged = parts[0].union(parts[1]).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    assert sorted(merged.collect()) == sorted(hosts.host_filter(listed, 64).collect())


def test_report_reads_packets_once_for_each_staged_table(spark, packets, monkeypatch):
    staged = {}

    def keep(df, folder, name):
        staged[name] = executed(df)
        return stage(df, folder, name)

    for module in (report, hosts):
        monkeypatch.setattr(module, "stage", keep)
    # Paths of scans in full.
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    try:
        built = report.build_report(packets, geo_view(spark, SF_DIR), "r")
        tables = [planned(rows) for rows in built]
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    source = packets.inputFiles()[0].rsplit("/", 2)[0].removeprefix("file://")
    reads = {n: p.count(f"file:{source}") for n, p in staged.items()}
    assert reads == {"hosts": 0, "pairs": 1, "places": 0, "seconds": 1, "totals": 1}
    assert not any(source in plan for plan in tables)


def test_aggregates_combine_before_the_shuffle(packets):
    for df in (talkers.host_bytes(packets, "src"), pairs.pair_counts(packets), rates.total_bytes(packets)):
        assert "functions=[partial_" in planned(df)


def test_unused_aggregates_and_columns_are_dropped(packets):
    plan = planned(rates.packets_per_second(packets))
    assert "data_length" not in plan and "protocol_name" not in plan


def test_ranking_keeps_k_rows_per_partition(packets):
    assert planned(talkers.top_hosts(packets, "src")).count("WindowGroupLimit") == 4
    assert planned(pairs.top_pairs(packets)).count("WindowGroupLimit") == 4
