"""Column expressions shared by the operators; all run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from wiretally.schema import OTHERS, PROTOCOLS

# Seconds of 0001-01-01T00:00:00Z and 9999-12-31T23:59:59Z: the span a
# four-digit year can print.
MIN_SECOND = -62_135_596_800
MAX_SECOND = 253_402_300_799

_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_IPV4 = rf"\A{_OCTET}(\.{_OCTET}){{3}}\z"


def number(text: Column) -> Column:
    """Decimal text to double, null for anything else.

    Java would also read ``1d``, ``0x1p3``, ``NaN`` and ``Infinity``; a letter
    other than the exponent sign therefore gives null.
    """
    return F.when(~text.rlike("[A-DF-Za-df-z]"), text.try_cast("double"))


def protocol_bucket(protocol: str = "protocol_name") -> Column:
    """One of the four named protocols, or the catch-all (null included)."""
    name = F.col(protocol)
    return F.when(name.isin(*PROTOCOLS), name).otherwise(F.lit(OTHERS))


def epoch_second(arrival: str = "arrival_time") -> Column:
    """Whole second of an epoch time, truncated toward zero."""
    return F.col(arrival).cast("bigint")


def time_bucket(width: int = 1, arrival: str = "arrival_time") -> Column:
    """First second of the ``width``-second bucket a packet falls in."""
    if width < 1:
        raise ValueError("width must be at least one second")
    second = epoch_second(arrival)
    return second if width == 1 else second - F.pmod(second, F.lit(width))


def wall_clock(second: Column, zone: str = "UTC") -> Column:
    """Zone-less local timestamp of an epoch second, whatever the session zone."""
    utc = F.timestamp_add("SECOND", second, F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"))
    return utc if zone == "UTC" else F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def readable_time(second: Column, zone: str = "UTC") -> Column:
    """Epoch second as ``MM-dd-yyyy HH:mm:ss`` text in ``zone``."""
    iso = wall_clock(second, zone).cast("string")
    return F.concat(
        F.substring(iso, 6, 5), F.lit("-"), F.substring(iso, 1, 4), F.substring(iso, 11, 9)
    )


def ip_to_long(address: str = "ip") -> Column:
    """Dotted IPv4 text to its 32-bit number, null when empty or malformed."""
    text = F.col(address)
    return F.when(text.rlike(_IPV4), _dotted(text))


def _dotted(text: Column) -> Column:
    value = F.lit(0).cast("bigint")
    for i in range(1, 5):
        value = value * 256 + F.split_part(text, F.lit("."), F.lit(i)).try_cast("bigint")
    return value


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def ipv6_halves(address: str = "ip") -> Column:
    """IPv6 text as ``struct(hi, lo)`` of two BIGINTs with the address's 128 bits; null if it is none.

    Takes the full and the shortened form, in either case, and a dotted IPv4
    tail; zone names are malformed.
    """
    return _let(F.lower(F.col(address)), lambda text: _let(_without_tail(text), _halves))


def _without_tail(text: Column) -> Column:
    """The text with a dotted tail as the two groups it stands for; null if that is no IPv4 address."""

    def hexes(tail: Column) -> Column:
        number = _dotted(tail)
        groups = (F.shiftright(number, 16), number.bitwiseAND(F.lit(65535)))
        return F.when(tail.rlike(_IPV4), F.lower(F.concat_ws(":", *map(F.hex, groups))))

    tail = _let(F.regexp_extract(text, r"([0-9.]+)\z", 1), hexes)
    return F.when(F.contains(text, F.lit(".")), F.concat(F.regexp_replace(text, r"[0-9.]+\z", ""), tail)).otherwise(text)


def _halves(text: Column) -> Column:
    none = F.array().cast("array<string>")

    def groups(side: Column) -> Column:
        return F.when(side == "", none).otherwise(F.split(side, ":", -1))

    def filled(sides: Column) -> Column:
        """All groups, zeros where they are left out; not eight if the text is malformed."""
        first, last = groups(F.get(sides, F.lit(0))), F.coalesce(groups(F.get(sides, F.lit(1))), none)
        missing = F.lit(8) - F.size(first) - F.size(last)
        usable = F.when(F.size(sides) == 2, missing >= 1).otherwise((F.size(sides) == 1) & (missing == 0))
        zeros = F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0)))
        return F.when(usable, F.concat(first, zeros, last))

    def numbers(every: Column) -> Column:
        known = F.forall(every, lambda g: g.rlike(r"\A[0-9a-f]{1,4}\z"))
        return F.when(known, F.transform(every, lambda g: F.conv(g, 16, 10).cast("bigint")))

    def halves(value: Column) -> Column:
        def half(at: int) -> Column:
            out = F.get(value, F.lit(at))
            for i in range(at + 1, at + 4):
                out = F.shiftleft(out, 16).bitwiseOR(F.get(value, F.lit(i)))
            return out

        return F.when(value.isNotNull(), F.struct(half(0).alias("hi"), half(4).alias("lo")))

    return _let(_let(_let(F.split(text, "::", -1), filled), numbers), halves)


def mapped_address(address: str = "ip") -> Column:
    """The IPv4 number of IPv4 text or of a mapped address (``::ffff:`` and 32 bits); null for others."""

    def last_bits(h: Column) -> Column:
        mapped = (h["hi"] == 0) & (F.shiftrightunsigned(h["lo"], 32) == 0xFFFF)
        return F.when(mapped, h["lo"].bitwiseAND(F.lit(2**32 - 1)))

    return F.coalesce(ip_to_long(address), _let(ipv6_halves(address), last_bits))
