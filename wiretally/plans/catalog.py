"""The registered queries: every operator over the packet and block views."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wiretally.functions.columns import epoch_second, protocol_bucket, readable_time
from wiretally.operators import geo, hosts, pairs, rates, talkers, totals
from wiretally.plans.flatten import report_values
from wiretally.plans.report import build_report
from wiretally.schema import CAPTURES
from wiretally.sinks import new_folder, write_table
from wiretally.sources.geo import conform_blocks, conform_networks6, count_block_rejects
from wiretally.sources.packets import (
    conform,
    count_rejects,
    count_typed_rejects,
    packet_text,
    parse_lines,
    read_captures,
    split_captures,
    union_captures,
    write_packet_text,
    write_packets,
)
from wiretally.sources.tables import (
    geo_view,
    mixed_addresses_view,
    mixed_networks_view,
    networks_view,
    packet_lines_view,
    packets_view,
    rough_packets,
    rough_ranges,
)
from wiretally.streaming import traffic

Query = Callable[[SparkSession, str], DataFrame]

FILTER_SRC = "10.0.0.7"
FILTER_DST = "10.0.0.3"
HOUR = 3600


def _on_packets(query: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: query(packets_view(spark, sf))


def _on_both(query: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: query(packets_view(spark, sf), geo_view(spark, sf))


def _busiest(p: DataFrame) -> DataFrame:
    return talkers.top_hosts_by_role(p)


def _top(role: str, metric: str) -> Query:
    return _on_packets(
        lambda p: talkers.top_hosts(p, role, metric).select("capture", "rank", "ip", "n")
    )


def _parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = packet_lines_view(spark, sf_dir)
    return union_captures(
        [parse_lines(lines.where(F.col("capture") == c).select("value"), c) for c in CAPTURES]
    )


def _text_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packets in the exporter's six-field form, read back."""
    p = packets_view(spark, sf_dir)
    return union_captures(
        [parse_lines(packet_text(p.where(F.col("capture") == c)), c) for c in CAPTURES]
    )


def _union(p: DataFrame) -> DataFrame:
    return union_captures([p.where(F.col("capture") == c) for c in CAPTURES])


def _summary(metric: str, width: int = 1) -> Query:
    return _on_packets(
        lambda p: rates.rate_summary(p, metric, width).select(
            "capture", F.round("average", 6).alias("average"), "minimum", "maximum"
        )
    )


def _map_rows(p: DataFrame) -> DataFrame:
    return rates.protocol_map(p).select("capture", F.explode("protocols").alias("bucket", "n"))


def _talkers_text(p: DataFrame) -> DataFrame:
    arrays = talkers.top_talkers_array(talkers.top_hosts(p, "src"))
    return arrays.select("capture", F.to_json("hosts").alias("hosts"))


def _attribute(*names: str) -> Query:
    return _on_both(lambda p, g: geo.geo_lookup(geo.distinct_ips(p), g).select("ip", *names))


def _profile(p: DataFrame, g: DataFrame) -> DataFrame:
    return hosts.host_profile(p, _busiest(p), g).select(
        "capture",
        "listed_as",
        "rank",
        "ip",
        "role",
        "packets",
        "bytes",
        "first_connection",
        "last_connection",
        readable_time(F.col("first_connection").cast("bigint")).alias("first_text"),
        "country",
    )


def _text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packets written as exporter text files, one folder a capture, and read from these."""
    p, folder = packets_view(spark, sf_dir), new_folder(spark, "text")
    for c in CAPTURES:
        write_packet_text(p.where(F.col("capture") == c), f"{folder}/{c}")
    return read_captures(spark, {c: f"{folder}/{c}" for c in CAPTURES})


def _rejected_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unusable lines of text files, from the pass that types the others."""
    lines, folder = packet_lines_view(spark, sf_dir), new_folder(spark, "text")
    for c in CAPTURES:
        lines.where(F.col("capture") == c).select("value").write.text(f"{folder}/{c}")
    paths = {c: f"{folder}/{c}" for c in CAPTURES}
    rejects = split_captures(spark, paths, new_folder(spark, "split"))[1]
    fields = F.split("line", ",")
    return rejects.select("capture", "reason", fields[0].alias("src"), F.size(fields).alias("fields"))


def _written_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result table as written and read back."""
    folder = new_folder(spark, "top")
    write_table(talkers.top_hosts(packets_view(spark, sf_dir), "src"), folder)
    return spark.read.parquet(folder).select("capture", "rank", "ip", "n")


def _kept_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair totals merged from two sources, one of them added twice."""
    p, folder = packets_view(spark, sf_dir), new_folder(spark, "totals")
    odd = F.col("data_length") % 2 == 1
    for source, rows in (("even", p.where(~odd)), ("odd", p.where(odd)), ("odd", p.where(odd))):
        totals.add_source(rows, folder, source)
    return totals.pair_totals(spark, folder)


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traffic per second from totals that a stream of the packets, written as files, has kept."""
    folder = new_folder(spark, "stream")
    write_packets(packets_view(spark, sf_dir), f"{folder}/packets")
    packets = traffic.stream_packets(spark, f"{folder}/packets")
    traffic.keep_totals(packets, f"{folder}/totals", f"{folder}/checkpoint").awaitTermination()
    return totals.traffic_totals(spark, f"{folder}/totals")


def _kept_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The addresses located by a kept table of pieces."""
    table = f"pieces_{uuid.uuid4().hex}"
    kept = geo.keep_pieces(geo_view(spark, sf_dir), table, new_folder(spark, "pieces"))
    return geo.geo_lookup(geo.distinct_ips(packets_view(spark, sf_dir)), kept)


def _mixed_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    networks = mixed_networks_view(spark, sf_dir)
    addresses = mixed_addresses_view(spark, sf_dir)
    return geo.geo_lookup(addresses, conform_blocks(networks), conform_networks6(networks))


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's values, from its header and tables."""
    return _on_both(lambda p, g: report_values(build_report(p, g, run_id="check")))(spark, sf_dir)


QUERIES: dict[str, Query] = {
    # sources
    "packets_scan": _on_packets(conform),
    "packets_parse": _parse,
    "packets_text": _text_form,
    "packets_rejects": lambda spark, sf: count_rejects(packet_lines_view(spark, sf)),
    "packets_text_files": _text_files,
    "rejected_lines": _rejected_lines,
    "capture_union": _on_packets(_union),
    "typed_rejects": _on_packets(lambda p: count_typed_rejects(rough_packets(p))),
    "geo_blocks": lambda spark, sf: conform_blocks(geo_view(spark, sf)),
    "geo_networks": lambda spark, sf: conform_blocks(networks_view(spark, sf)),
    "geo_networks6": lambda spark, sf: conform_networks6(mixed_networks_view(spark, sf)),
    "block_rejects": lambda spark, sf: union_captures(
        [count_block_rejects(t(spark, sf)) for t in (networks_view, rough_ranges)]
    ),
    # projections, filters, scalar functions
    "project_endpoints": _on_packets(lambda p: p.select("src", "dst")),
    "filter_src": _on_packets(lambda p: p.where(F.col("src") == FILTER_SRC)),
    "filter_dst": _on_packets(lambda p: p.where(F.col("dst") == FILTER_DST)),
    "epoch_second": _on_packets(lambda p: p.select("capture", epoch_second().alias("second"))),
    "readable_time": _on_packets(
        lambda p: p.select("capture", readable_time(epoch_second()).alias("readable"))
    ),
    "protocol_bucket": _on_packets(
        lambda p: p.select("capture", "protocol_name", protocol_bucket().alias("bucket"))
    ),
    "protocol_map": _on_packets(_map_rows),
    "top_talkers_array": _on_packets(_talkers_text),
    # aggregations
    "count_by_src": _on_packets(lambda p: talkers.host_counts(p, "src")),
    "count_by_dst": _on_packets(lambda p: talkers.host_counts(p, "dst")),
    "bytes_by_src": _on_packets(lambda p: talkers.host_bytes(p, "src")),
    "bytes_by_dst": _on_packets(lambda p: talkers.host_bytes(p, "dst")),
    "protocol_distribution": _on_packets(rates.protocol_distribution),
    "packets_per_second": _on_packets(rates.packets_per_second),
    "packets_per_hour": _on_packets(lambda p: rates.packets_per_second(p, HOUR)),
    "bytes_per_second": _on_packets(rates.bytes_per_second),
    "bytes_per_hour": _on_packets(lambda p: rates.bytes_per_second(p, HOUR)),
    "protocol_per_second": _on_packets(rates.protocol_per_second),
    "protocol_per_hour": _on_packets(lambda p: rates.protocol_per_second(p, HOUR)),
    "packet_rate_summary": _summary("packets"),
    "byte_rate_summary": _summary("bytes"),
    "packet_rate_summary_hourly": _summary("packets", HOUR),
    "byte_rate_summary_hourly": _summary("bytes", HOUR),
    "packets_per_hour_filled": _on_packets(
        lambda p: rates.packets_per_second(p, HOUR, idle=True)
    ),
    "packet_rate_summary_idle": _on_packets(
        lambda p: rates.rate_summary(p, idle=True).select(
            "capture", F.round("average", 6).alias("average"), "minimum", "maximum"
        )
    ),
    "kept_pair_totals": _kept_pairs,
    "streamed_traffic": _streamed,
    "written_top_src": _written_table,
    "total_bytes": _on_packets(rates.total_bytes),
    "second_index": _on_packets(
        lambda p: rates.packets_per_second(p).select("capture", "second", "idx")
    ),
    "host_profile": _on_both(_profile),
    "host_protocols": _on_packets(lambda p: hosts.host_protocols(p, _busiest(p))),
    "pair_counts": _on_packets(pairs.pair_counts),
    "pair_range": _on_packets(lambda p: pairs.pair_range(pairs.pair_counts(p))),
    # top-k
    "top_src_packets": _top("src", "packets"),
    "top_dst_packets": _top("dst", "packets"),
    "top_src_bytes": _top("src", "bytes"),
    "top_dst_bytes": _top("dst", "bytes"),
    "top_pairs": _on_packets(pairs.top_pairs),
    "top_victims": _on_packets(pairs.top_victims),
    # set operations
    "all_endpoints": _on_packets(geo.all_endpoints),
    "distinct_ips": _on_packets(geo.distinct_ips),
    # joins
    "top_host_packets": _on_packets(
        lambda p: hosts.host_packets(p, talkers.top_hosts(p, "src"))
    ),
    "geo_lookup": _on_both(lambda p, g: geo.geo_lookup(geo.distinct_ips(p), g)),
    "geo_lookup_kept": _kept_lookup,
    "geo_lookup_mixed": _mixed_lookup,
    "geo_country": _attribute("country"),
    "geo_city": _attribute("city"),
    "geo_location": _attribute("latitude", "longitude"),
    "geo_map": _on_both(geo.geo_map),
    # hours, peer countries and top countries
    "host_hours": _on_packets(lambda p: hosts.host_hours(p, _busiest(p))),
    "host_peer_countries": _on_both(
        lambda p, g: hosts.host_peer_countries(p, _busiest(p), g)
    ),
    "top_countries": _on_both(geo.top_countries),
    # the values of the whole report as rows
    "report_values": report,
}
