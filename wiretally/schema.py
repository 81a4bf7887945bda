"""Table and document shapes, and the fixed values results depend on."""

from __future__ import annotations

from pyspark.sql import types as T

# Capture labels, protocol names with their catch-all bucket,
# lookup defaults, report sizes and the constant report owner.
CAPTURES = ("normal", "attack")
PROTOCOLS = ("HTTP", "TCP", "ICMP", "UDP")
OTHERS = "others"
BUCKETS = (*PROTOCOLS, OTHERS)
NAME_NOT_FOUND = "not found"
COORDINATE_NOT_FOUND = 0.0
TOP_HOSTS = 10
TOP_PAIRS = 2000
REPORT_USER = "NA"

ROLES = ("src", "dst")


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_LONG, _DOUBLE, _STRING = T.LongType(), T.DoubleType(), T.StringType()

PACKET_SCHEMA = _struct(
    capture=_STRING,
    src=_STRING,
    dst=_STRING,
    data_length=_LONG,
    protocol_name=_STRING,
    protocol_number=T.IntegerType(),
    arrival_time=_DOUBLE,
)

GEO_SCHEMA = _struct(
    ip_from=_LONG,
    ip_to=_LONG,
    prefix_len=T.IntegerType(),
    country=_STRING,
    city=_STRING,
    latitude=_DOUBLE,
    longitude=_DOUBLE,
)

# IPv6 networks: the first address's 128 bits as two numbers.
NETWORK6_SCHEMA = _struct(
    hi=_LONG,
    lo=_LONG,
    prefix_len=T.IntegerType(),
    country=_STRING,
    city=_STRING,
    latitude=_DOUBLE,
    longitude=_DOUBLE,
)

RATE_SCHEMA = _struct(
    **{
        f"{capture}_{name}": kind
        for name, kind in (("Average", _DOUBLE), ("min", _LONG), ("max", _LONG))
        for capture in CAPTURES
    }
)
DISTRIBUTION_SCHEMA = _struct(
    **{c: _struct(**{b: _LONG for b in BUCKETS}, x=_LONG) for c in CAPTURES}
)


def _role_profile(bytes_name: str) -> T.StructType:
    return _struct(
        PacketNumber=_LONG,
        **{bytes_name: _LONG},
        FirstConnection=_STRING,
        LastConnection=_STRING,
        Country=_struct(name=_STRING),
        Hours=T.ArrayType(_struct(Hour=T.IntegerType(), rate=_LONG)),
    )


PROFILE_SCHEMA = _struct(
    IP=_STRING,
    Source=_role_profile("sendData"),
    Destination=_role_profile("receiveData"),
)
BEHAVIOUR_SCHEMA = _struct(
    **{
        f"{capture}BehaviorOf{role}": T.ArrayType(PROFILE_SCHEMA)
        for capture in ("attack", "normal")
        for role in ("Source", "Destination")
    }
)
_PAIR_LIST = T.ArrayType(_struct(source=_STRING, destination=_STRING, value=_LONG))
MAP_SCHEMA = _struct(
    attackDS=_PAIR_LIST,
    normalDS=_PAIR_LIST,
    victimData=T.ArrayType(_struct(destination=_STRING, value=_LONG)),
)

REPORT_SCHEMA = _struct(
    run_id=_STRING,
    user=_STRING,
    AveragePacketRate=RATE_SCHEMA,
    AveragePacketData=RATE_SCHEMA,
    ProtocolDistribution=DISTRIBUTION_SCHEMA,
    BehaviorOfTopIP=BEHAVIOUR_SCHEMA,
    Map=MAP_SCHEMA,
)
