"""Packets and bytes per host, and the busiest hosts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiretally.operators.ranking import top_k
from wiretally.schema import ROLES, TOP_HOSTS


def host_counts(packets: DataFrame, role: str) -> DataFrame:
    """``(capture, ip, n)``: packets per host as ``src`` or ``dst``."""
    return packets.groupBy("capture", F.col(_role(role)).alias("ip")).agg(
        F.count("*").alias("n")
    )


def host_bytes(packets: DataFrame, role: str) -> DataFrame:
    """``(capture, ip, n)``: bytes per host as ``src`` or ``dst``."""
    return packets.groupBy("capture", F.col(_role(role)).alias("ip")).agg(
        F.sum("data_length").alias("n")
    )


def top_hosts(
    packets: DataFrame, role: str, metric: str = "packets", k: int = TOP_HOSTS
) -> DataFrame:
    """The ``k`` busiest hosts per capture, by ``packets`` or ``bytes``."""
    totals = {"packets": host_counts, "bytes": host_bytes}[metric]
    return top_k(totals(packets, role), k)


def role_counts(traffic: DataFrame, weight: str | None = None) -> DataFrame:
    """``(capture, role, ip, n)`` for both roles: rows, or the sum of the column ``weight``.

    Packets have no weight; pair counts have ``n``.
    """
    ends = F.array(
        *[F.struct(F.lit(r).alias("role"), F.col(r).alias("ip")) for r in ROLES]
    )
    return (
        traffic.select("capture", *[weight] * (weight is not None), F.explode(ends).alias("end"))
        .groupBy("capture", "end.role", "end.ip")
        .agg((F.count("*") if weight is None else F.sum(weight)).alias("n"))
    )


def top_hosts_by_role(
    traffic: DataFrame, k: int = TOP_HOSTS, weight: str | None = None
) -> DataFrame:
    """``(capture, listed_as, rank, ip, n)``: both busiest-host lists at once."""
    return top_k(role_counts(traffic, weight), k, by=("capture", "role")).select(
        "capture", F.col("role").alias("listed_as"), "rank", "ip", "n"
    )


def top_talkers_array(top: DataFrame) -> DataFrame:
    """``(capture, hosts)``: ranked hosts as one array of ``{ip: n}`` maps.

    ``top`` holds at most k rows per capture.
    """
    ranked = F.sort_array(F.collect_list(F.struct("rank", "ip", "n")))
    return (
        top.groupBy("capture")
        .agg(ranked.alias("r"))
        .select(
            "capture",
            F.transform("r", lambda h: F.create_map(h["ip"], h["n"])).alias("hosts"),
        )
    )


def _role(role: str) -> str:
    if role not in ROLES:
        raise ValueError(f"role must be one of {ROLES}")
    return role
