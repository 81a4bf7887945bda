"""Address location: distinct addresses, and the block each one lies in.

A ``between`` join would compare every address with every block. Here each
block is cut into aligned pieces of five fixed sizes, /16 to /32, each kept
once. Pieces of one size do not overlap, so the only piece of a size that can
hold an address is the last one to start at or before it. Addresses and pieces
are shuffled by /16 and sorted together, and one running window carries the
last piece of each size along: an address is shuffled once, whatever the
number and overlap of the blocks. A /16 holds at most 65,536 addresses and
some 70,000 pieces.

Where several jobs locate by the same blocks, ``keep_pieces`` writes the pieces
once as a table bucketed by /16, and lookups by it shuffle addresses only.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wiretally.functions.columns import ip_to_long, mapped_address
from wiretally.operators.geo6 import locate6
from wiretally.operators.ranking import top_k
from wiretally.schema import COORDINATE_NOT_FOUND, NAME_NOT_FOUND

_LEVELS = (16, 20, 24, 28, 32)
_ATTRIBUTES = ("country", "city", "latitude", "longitude")


def all_endpoints(packets: DataFrame) -> DataFrame:
    """``(ip)``: both addresses of every packet, duplicates kept."""
    return packets.select(F.explode(F.array("src", "dst")).alias("ip"))


def distinct_ips(packets: DataFrame) -> DataFrame:
    return all_endpoints(packets).distinct()


def _piece(level: int, unit: str) -> str:
    """Key of a piece: the level in the high half, the piece number in the low half."""
    return f"({unit}) + {level * 2**32}L"


def _runs(ranges: DataFrame) -> DataFrame:
    """``(first, end, hit)``: runs of adjacent pieces that make up each range, by key.

    Of every size only what larger pieces leave over is taken: one run for the
    largest size, and one at either end for the others. Most are empty.
    """
    bounds, runs, outer = [], [], None
    for level in _LEVELS:
        shift = 32 - level
        # Whole pieces of this size inside the range: low up to high, without high.
        bounds += [
            f"shiftright(ip_from + {2**shift - 1}L, {shift}) as low_{level}",
            f"shiftright(ip_to + 1, {shift}) as high_{level}",
        ]
        low, high = f"low_{level}", f"high_{level}"
        if outer is None:
            runs.append((level, low, high))
        else:
            covered = f"low_{outer} < high_{outer}"
            runs.append((level, low, f"if({covered}, low_{outer} * 16, {high})"))
            runs.append((level, f"if({covered}, high_{outer} * 16, {high})", high))
        outer = level
    keys = ", ".join(
        f"struct({_piece(n, first)} as first, {_piece(n, end)} as end)" for n, first, end in runs
    )
    return (
        ranges.selectExpr("hit", *bounds)
        .selectExpr(f"inline(array({keys}))", "hit")
        .where("first < end")
    )


def block_pieces(blocks: DataFrame) -> DataFrame:
    """``(piece, hit)``: each aligned piece once, with its most specific block.

    Longest ``prefix_len`` wins, then the narrower range, then the lower start,
    then the attribute values, so the choice never depends on row order.
    """
    valid = blocks.where(
        (F.col("ip_from") >= 0) & (F.col("ip_to") < 2**32) & (F.col("ip_from") <= F.col("ip_to"))
    )
    hit = F.struct(
        F.coalesce("prefix_len", F.lit(-1)).alias("prefix_len"),
        (F.col("ip_from") - F.col("ip_to")).alias("narrow"),
        (-F.col("ip_from")).alias("start"),
        *_ATTRIBUTES,
    )
    # Copies of a range collapse before it is cut up.
    ranges = valid.groupBy("ip_from", "ip_to").agg(F.max(hit).alias("hit"))
    pieces = _runs(ranges).selectExpr("explode(sequence(first, end - 1)) as piece", "hit")
    return pieces.groupBy("piece").agg(F.max("hit").alias("hit"))


class Pieces(NamedTuple):
    """A kept table of pieces, in ``buckets`` files by hash of ``block``, their /16."""

    table: DataFrame
    buckets: int


Blocks = DataFrame | Pieces


def placed_pieces(blocks: DataFrame) -> DataFrame:
    """``(level, piece, hit, block, at)``: each piece with its /16 and first address."""
    pieces = block_pieces(blocks).selectExpr(
        "cast(shiftright(piece, 32) as int) as level", "piece", "hit"
    )
    starts = F.expr("shiftleft(piece & 4294967295L, 32 - level)")
    return pieces.select(
        "level", "piece", "hit", F.shiftright(starts, 16).alias("block"), starts.alias("at")
    )


def keep_pieces(blocks: DataFrame, table: str, path: str, buckets: int = 200) -> Pieces:
    """Write the pieces of ``blocks`` as ``table`` under ``path``, replacing both.

    One file a bucket; the number of buckets is that of the tasks of every lookup.
    """
    (
        placed_pieces(blocks)
        .repartition(buckets, "block")
        .write.mode("overwrite")
        .bucketBy(buckets, "block")
        .sortBy("block", "at")
        .option("path", path)
        .saveAsTable(table)
    )
    return kept_pieces(blocks.sparkSession, table)


def kept_pieces(spark: SparkSession, table: str) -> Pieces:
    """A table that ``keep_pieces`` wrote; another table raises ``ValueError``."""
    described = {r["col_name"]: r["data_type"] for r in spark.sql(f"describe extended {table}").collect()}
    if described.get("Bucket Columns") != "[`block`]":
        raise ValueError(f"{table} is not bucketed by block")
    return Pieces(spark.read.table(table), int(described["Num Buckets"]))


def locate(rows: DataFrame, blocks: Blocks, address: str = "ip") -> DataFrame:
    """Add ``found, country, city, latitude, longitude`` of ``address`` to rows.

    ``blocks`` are a block table, or pieces kept of one. Addresses in no block, empty or malformed get the not-found values; a null
    attribute of a matching block stays null. Rows of one address meet in one
    task: their number must be bounded.
    """
    kept = rows.columns
    # Malformed addresses get /16 numbers no block has, spread over many tasks.
    nowhere = F.expr(f"-1L - pmod(xxhash64(`{address}`), {2**31}L)")
    wanted = rows.withColumn("_value", ip_to_long(address)).select(
        F.struct(*kept).alias("row"),
        F.coalesce(F.shiftright("_value", 16), nowhere).alias("lane"),
        F.coalesce("_value", F.lit(-1)).alias("at"),
    )
    if isinstance(blocks, Pieces):
        # Dealt as the buckets are, so that the union of the two is shuffled no more.
        pieces, wanted = blocks.table, wanted.repartition(blocks.buckets, "lane")
    else:
        pieces = placed_pieces(blocks)
    # Under another name than the table's: its qualified column would hide from the union
    # that both sides are dealt alike.
    sorted_in = pieces.withColumnRenamed("block", "lane").unionByName(wanted, allowMissingColumns=True)
    # Pieces come before the addresses at their start.
    so_far = Window.partitionBy("lane").orderBy("at", F.col("level").asc_nulls_last())
    last = [
        F.last(F.expr(f"if(level = {n}, struct(piece, hit), null)"), ignorenulls=True)
        .over(so_far.rowsBetween(Window.unboundedPreceding, 0))
        .alias(f"last_{n}")
        for n in _LEVELS
    ]
    holding = ", ".join(
        f"if(last_{n}.piece = {_piece(n, f'shiftright(at, {32 - n})')}, last_{n}.hit, null)"
        for n in _LEVELS
    )
    located = (
        sorted_in.select("row", "at", *last)
        .where("row is not null")
        .select("row.*", F.expr(f"greatest({holding})").alias("hit"))
    )
    return _with_attributes(located, kept)


def _with_attributes(located: DataFrame, kept: list[str]) -> DataFrame:
    """``kept`` with the attributes of ``hit``, or their defaults without one."""
    found = F.col("hit").isNotNull()

    def attribute(name: str, default: object) -> Column:
        return F.when(found, F.col(f"hit.{name}")).otherwise(F.lit(default)).alias(name)

    return located.select(
        *kept,
        found.alias("found"),
        attribute("country", NAME_NOT_FOUND),
        attribute("city", NAME_NOT_FOUND),
        attribute("latitude", COORDINATE_NOT_FOUND),
        attribute("longitude", COORDINATE_NOT_FOUND),
    )


def geo_lookup(addresses: DataFrame, blocks: Blocks, networks6: DataFrame | None = None) -> DataFrame:
    """``(ip, found, country, city, latitude, longitude)``, one row per distinct ``ip``.

    ``blocks`` locate IPv4 addresses and, if given, ``networks6`` those of IPv6.
    """
    distinct = addresses.select("ip").distinct()
    return locate(distinct, blocks) if networks6 is None else locate_mixed(distinct, blocks, networks6)


def locate_mixed(
    rows: DataFrame, blocks: Blocks, networks6: DataFrame, address: str = "ip"
) -> DataFrame:
    """``locate`` for addresses of both families; IPv4-mapped ones are located as IPv4."""
    kept = rows.columns
    # Names that no column has.
    number, text = ("_" * max(map(len, kept)) + n for n in ("_number", "_dotted"))
    numbered = rows.withColumn(number, mapped_address(address))
    octets = [F.shiftright(number, s).bitwiseAND(F.lit(255)) for s in (24, 16, 8, 0)]
    four = numbered.where(F.col(number).isNotNull()).withColumn(text, F.concat_ws(".", *octets))
    six = numbered.where(F.col(number).isNull()).drop(number)
    return (
        locate(four, blocks, text)
        .drop(number, text)
        .unionByName(_with_attributes(locate6(six, networks6, address), kept))
    )


def geo_map(packets: DataFrame, blocks: Blocks, networks6: DataFrame | None = None) -> DataFrame:
    """``(ip, longitude, latitude)`` of every address seen."""
    return geo_lookup(distinct_ips(packets), blocks, networks6).select("ip", "longitude", "latitude")


def top_countries(
    packets: DataFrame, blocks: Blocks, k: int = 10, role: str = "src"
) -> DataFrame:
    """``(capture, rank, country, n)``: countries by packets of their hosts in ``role``."""
    per_host = packets.groupBy("capture", F.col(role).alias("ip")).agg(
        F.count("*").alias("n")
    )
    per_country = (
        locate(per_host, blocks).groupBy("capture", "country").agg(F.sum("n").alias("n"))
    )
    return top_k(per_country, k, ties=("country",)).select("capture", "rank", "country", "n")
