"""The whole job: captures in, report out.

    python -m wiretally --normal normal.csv --attack attack.csv \\
        --blocks blocks.parquet --report reports/
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wiretally.operators import geo, pairs, rates, talkers
from wiretally.plans.report import build_report
from wiretally.schema import ROLES, TOP_HOSTS, TOP_PAIRS
from wiretally.sinks import write_report, write_table
from wiretally.sources.geo import (
    conform_blocks,
    conform_networks6,
    count_block_rejects,
    network_locations,
    read_block_table,
)
from wiretally.sources.packets import (
    count_capture_rejects,
    count_rejected,
    read_captures,
    split_captures,
    write_packets,
)


def main(argv: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="wiretally", description=__doc__.splitlines()[0])
    parser.add_argument("--normal", required=True, help="exporter text of the normal capture")
    parser.add_argument("--attack", required=True, help="exporter text of the attack capture")
    parser.add_argument("--blocks", required=True, help="IP-block table")
    parser.add_argument("--blocks-format", default="parquet", choices=("parquet", "csv"))
    parser.add_argument("--locations", help="location CSV, if the blocks only name location ids")
    parser.add_argument("--report", required=True, help="folder the report is appended to")
    parser.add_argument("--report-format", default="json")
    parser.add_argument("--packets", help="keep the typed packets here and read them back")
    parser.add_argument("--rejects", help="folder for counts of unusable lines and blocks; with --packets, for the lines too")
    parser.add_argument("--tables", help="folder for the result tables, each replaced")
    parser.add_argument("--run-id")
    parser.add_argument("--hosts", type=int, default=TOP_HOSTS, help="hosts per list")
    parser.add_argument("--pairs", type=int, default=TOP_PAIRS, help="pairs per list")
    parser.add_argument("--zone", default="UTC", help="time zone of readable times")
    parser.add_argument("--drop-blank-ip", action="store_true")
    args = parser.parse_args(argv)

    # A session that already runs is taken as it is.
    spark = SparkSession.getActiveSession() or SparkSession.builder.appName("wiretally").getOrCreate()
    paths = {"normal": args.normal, "attack": args.attack}
    rejects = None
    if args.packets and args.rejects:
        # One pass over the text keeps both.
        packets, rejects = split_captures(spark, paths, args.packets)
        if args.drop_blank_ip:
            packets = packets.where((F.col("src") != "") & (F.col("dst") != ""))
    else:
        packets = read_captures(spark, paths, args.drop_blank_ip)
        if args.packets:
            packets = write_packets(packets, args.packets)
    if args.locations:
        table = network_locations(spark, args.blocks, args.locations)
    else:
        table = read_block_table(spark, args.blocks, args.blocks_format)
    blocks = conform_blocks(table)
    networks6 = conform_networks6(table) if "network" in table.columns else None
    if args.rejects:
        counts = count_capture_rejects(spark, paths) if rejects is None else count_rejected(rejects)
        write_table(counts, f"{args.rejects}/packets")
        if rejects is not None:
            write_table(rejects, f"{args.rejects}/lines")
        write_table(count_block_rejects(table), f"{args.rejects}/blocks")
    if args.tables:
        tables = result_tables(packets, blocks, args.hosts, args.pairs, networks6)
        for name, result in tables.items():
            write_table(result, f"{args.tables}/{name}")
    report = build_report(
        packets, blocks, args.run_id, args.hosts, args.pairs, args.zone, networks6
    )
    write_report(report, args.report, args.report_format)


def result_tables(
    packets: DataFrame,
    blocks: DataFrame,
    hosts_k: int,
    pairs_k: int,
    networks6: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """The lists and series that a report starts from, by table name."""
    top = {
        f"top_{role}_{metric}": talkers.top_hosts(packets, role, metric, hosts_k)
        for role in ROLES
        for metric in ("packets", "bytes")
    }
    return top | {
        "rates": rates.with_index(rates.traffic_per_bucket(packets)),
        "pairs": pairs.top_pairs(packets, pairs_k),
        "victims": pairs.top_victims(packets, pairs_k),
        "map": geo.geo_map(packets, blocks, networks6),
    }


if __name__ == "__main__":
    main()
