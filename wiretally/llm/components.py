"""Connected components of links between numbers, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiretally.llm.common import staged


def _stars(edges: DataFrame, mins: DataFrame) -> DataFrame:
    return edges.join(mins, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each larger neighbour of a node to the node's smallest neighbour or itself."""
    both = edges.union(edges.select("v", "u"))
    mins = both.groupBy("u").agg(F.min("v").alias("m"))
    return (
        _stars(both.where("v > u"), mins)
        .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        .where("u <> v")
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    mins = down.groupBy("u").agg(F.min("v").alias("m"))
    return (
        _stars(down, mins)
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .union(mins.select("u", F.col("m").alias("v")))
        .where("u <> v")
        .distinct()
    )


def connected_components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (``u, v``), root the smallest node reachable.

    Nodes without a link to another one are left out. Each round is staged; the
    driver sees only a row count and a sum of hashes, which tell when it is done.
    A node with very many links is met by partial aggregation and by joins that
    Spark can split.
    """
    edges = staged(links.select("u", "v").where("u <> v").distinct(), "edges")
    before = None
    while True:
        stars = staged(_small_star(_large_star(edges)), "edges")
        mark = stars.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).head()
        if tuple(mark) == before:
            break
        edges, before = stars, tuple(mark)
    roots = stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(stars.select("v", "v").distinct())
