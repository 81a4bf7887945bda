"""The registered queries in ANSI SQL, for DuckDB over the same tables."""

from __future__ import annotations

from wiretally.plans.catalog import FILTER_DST, FILTER_SRC, HOUR
from wiretally.schema import BUCKETS, CAPTURES, TOP_HOSTS, TOP_PAIRS

PACKETS = """packets AS (
  SELECT CASE WHEN event_id % 4 = 0 THEN 'attack' ELSE 'normal' END AS capture,
         '10.0.' || CAST(user_id // 256 AS VARCHAR) || '.' || CAST(user_id % 256 AS VARCHAR) AS src,
         '10.0.0.' || CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 AS VARCHAR) AS dst,
         CAST(floor(value) AS BIGINT) + 60 AS data_length,
         CASE event_type WHEN 'click' THEN 'TCP' WHEN 'view' THEN 'HTTP'
              WHEN 'purchase' THEN 'UDP' WHEN 'error' THEN 'ICMP' ELSE 'DNS' END AS protocol_name,
         CASE event_type WHEN 'click' THEN 6 WHEN 'view' THEN 6 WHEN 'error' THEN 1 ELSE 17 END
           AS protocol_number,
         epoch_us(ts) / 1000000.0 AS arrival_time
  FROM events)"""

BLOCKS = """blocks AS (
  SELECT CAST(167772160 + n_nationkey * 8 AS BIGINT) AS ip_from,
         CAST(167772160 + n_nationkey * 8 + 5 AS BIGINT) AS ip_to,
         29 AS prefix_len, n_name AS country, 'CITY_' || CAST(n_nationkey AS VARCHAR) AS city,
         CASE WHEN n_nationkey % 7 <> 0 THEN CAST(n_nationkey AS DOUBLE) * 1.5 END AS latitude,
         CAST(n_nationkey AS DOUBLE) * -2.5 - 1 AS longitude
  FROM nation
  UNION ALL
  SELECT CAST(167772160 + 64 + r_regionkey * 256 AS BIGINT),
         CAST(167772160 + 127 + r_regionkey * 256 AS BIGINT),
         26, r_name, CAST(NULL AS VARCHAR),
         CAST(r_regionkey AS DOUBLE) * 3 + 0.5, CAST(r_regionkey AS DOUBLE) * 4 + 0.25
  FROM region)"""

# Whole seconds truncate toward zero, as the cast in the Spark queries does.
SECONDS = """seconds AS (
  SELECT *, CAST(trunc(arrival_time) AS BIGINT) AS second FROM packets)"""

BUCKET = (
    "CASE WHEN protocol_name IN ('HTTP', 'TCP', 'ICMP', 'UDP')"
    " THEN protocol_name ELSE 'others' END"
)
READABLE = "strftime(make_timestamp({} * 1000000), '%m-%d-%Y %H:%M:%S')"

PAIRS = """pairs AS (
  SELECT capture, src, dst, count(*) AS n FROM packets GROUP BY capture, src, dst)"""
RANGES = """ranges AS (
  SELECT capture, max(n) AS highest, min(n) AS lowest FROM pairs GROUP BY capture)"""
TOP = f"""top AS (
  SELECT capture, rank, src, dst, n,
         CASE WHEN highest = lowest THEN 0
              ELSE 100 * (highest - n) // (highest - lowest) END AS value
  FROM (SELECT *, row_number() OVER (PARTITION BY capture ORDER BY n DESC, src, dst) AS rank
        FROM pairs) JOIN ranges USING (capture)
  WHERE rank <= {TOP_PAIRS})"""

ROLES = """roles AS (
  SELECT capture, 'src' AS role, src AS ip, dst AS peer, data_length, protocol_name, arrival_time
  FROM packets
  UNION ALL
  SELECT capture, 'dst', dst, src, data_length, protocol_name, arrival_time FROM packets)"""
LISTED = f"""listed AS (
  SELECT * FROM (
    SELECT capture, role AS listed_as, ip, n,
           row_number() OVER (PARTITION BY capture, role ORDER BY n DESC, ip) AS rank
    FROM (SELECT capture, role, ip, count(*) AS n FROM roles GROUP BY capture, role, ip))
  WHERE rank <= {TOP_HOSTS}),
listed_rows AS (
  SELECT * FROM roles WHERE (capture, ip) IN (SELECT (capture, ip) FROM listed))"""

HOURS = """SELECT capture, ip, role, hour, count(*) AS rate
FROM (SELECT capture, ip, role,
             CAST((CAST(trunc(arrival_time) AS BIGINT) % 86400) // 3600 AS INTEGER) AS hour
      FROM listed_rows)
GROUP BY capture, ip, role, hour"""

# Every address with its most specific block.
LOCATED = """ips AS (
  SELECT DISTINCT ip FROM (SELECT src AS ip FROM packets UNION ALL SELECT dst FROM packets)),
numbered AS (
  SELECT ip, CAST(split_part(ip, '.', 1) AS BIGINT) * 16777216
             + CAST(split_part(ip, '.', 2) AS BIGINT) * 65536
             + CAST(split_part(ip, '.', 3) AS BIGINT) * 256
             + CAST(split_part(ip, '.', 4) AS BIGINT) AS v
  FROM ips),
located AS (
  SELECT ip, v, hit AS found,
         CASE WHEN hit THEN country ELSE 'not found' END AS country,
         CASE WHEN hit THEN city ELSE 'not found' END AS city,
         CASE WHEN hit THEN latitude ELSE 0.0 END AS latitude,
         CASE WHEN hit THEN longitude ELSE 0.0 END AS longitude
  FROM (
    SELECT ip, v, ip_from IS NOT NULL AS hit, country, city, latitude, longitude,
           row_number() OVER (PARTITION BY ip ORDER BY prefix_len DESC) AS choice
    FROM numbered LEFT JOIN blocks ON v BETWEEN ip_from AND ip_to)
  WHERE choice = 1)"""


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def _packets(select: str) -> str:
    return _with(PACKETS) + select


def _grouped(role: str, value: str) -> str:
    return _packets(f"SELECT capture, {role} AS ip, {value} AS n FROM packets GROUP BY capture, {role}")


def _top_hosts(role: str, value: str) -> str:
    return _packets(
        f"""SELECT capture, rank, ip, n FROM (
  SELECT *, row_number() OVER (PARTITION BY capture ORDER BY n DESC, ip) AS rank
  FROM (SELECT capture, {role} AS ip, {value} AS n FROM packets GROUP BY capture, {role}))
WHERE rank <= {TOP_HOSTS}"""
    )


BYTES = "CAST(sum(data_length) AS BIGINT)"


def _bucketed(width: int, columns: str) -> str:
    return f"""series AS (
  SELECT capture, second - second % {width} AS second, {columns}
  FROM seconds GROUP BY capture, second - second % {width}),
indexed AS (
  SELECT *, row_number() OVER (PARTITION BY capture ORDER BY second) - 1 AS idx FROM series)"""


def _series(value: str, width: int) -> str:
    return (
        _with(PACKETS, SECONDS, _bucketed(width, f"{value} AS value"))
        + "SELECT capture, second, idx, value FROM indexed"
    )


PER_PROTOCOL = ", ".join(f"count(*) FILTER (WHERE {BUCKET} = '{b}') AS \"{b}\"" for b in BUCKETS)


def _protocols(width: int) -> str:
    names = ", ".join(f'"{b}"' for b in BUCKETS)
    return (
        _with(PACKETS, SECONDS, _bucketed(width, PER_PROTOCOL))
        + f"SELECT capture, second, idx, {names} FROM indexed"
    )


def _summary(value: str, width: int) -> str:
    return (
        _with(PACKETS, SECONDS, _bucketed(width, f"{value} AS value"))
        + "SELECT capture, round(avg(value), 6) AS average, min(value) AS minimum,"
        " max(value) AS maximum FROM series GROUP BY capture"
    )


DISTRIBUTION = f"""distribution AS (
  SELECT capture, bucket, n, count(*) OVER (PARTITION BY capture) AS buckets
  FROM (SELECT capture, {BUCKET} AS bucket, count(*) AS n FROM packets GROUP BY 1, 2))"""

PROFILE = """profile AS (
  SELECT l.capture, l.listed_as, l.rank, l.ip, r.role,
         coalesce(t.packets, 0) AS packets, coalesce(t.bytes, 0) AS bytes,
         t.first_connection, t.last_connection, g.country
  FROM listed l
  CROSS JOIN (VALUES ('src'), ('dst')) r(role)
  LEFT JOIN (SELECT capture, ip, role, count(*) AS packets,
                    CAST(sum(data_length) AS BIGINT) AS bytes,
                    min(arrival_time) AS first_connection, max(arrival_time) AS last_connection
             FROM listed_rows GROUP BY capture, ip, role) t
    ON t.capture = l.capture AND t.ip = l.ip AND t.role = r.role
  LEFT JOIN located g ON g.ip = l.ip)"""


def _located(columns: str) -> str:
    return _with(PACKETS, BLOCKS, LOCATED) + f"SELECT {columns} FROM located"


def _report_values() -> str:
    """The report's values, one row each."""
    rows: list[str] = []

    def add(section: str, position: str, label: str, number: str, text: str, source: str) -> None:
        rows.append(
            f"SELECT {section} AS section, {position} AS position, {label} AS label,"
            f" round(CAST({number} AS DOUBLE), 6) AS number, {text} AS text FROM {source}"
        )

    no_text = "CAST(NULL AS VARCHAR)"
    no_number = "CAST(NULL AS DOUBLE)"
    for block, metric in (("AveragePacketRate", "packets"), ("AveragePacketData", "bytes")):
        add(f"'{block}.' || capture || '_X'", "idx", no_text, "idx", no_text, "indexed")
        add(f"'{block}.' || capture || '_Y'", "idx", no_text, metric, no_text, "indexed")
        for name, function in (("Average", "avg"), ("min", "min"), ("max", "max")):
            add(
                f"'{block}.' || capture || '_{name}'",
                "CAST(0 AS BIGINT)",
                no_text,
                "v",
                no_text,
                f"(SELECT capture, {function}({metric}) AS v FROM indexed GROUP BY capture)",
            )
    for b in BUCKETS:
        add(
            f"'AverageProtocolRate.' || capture || '.{b}'",
            "idx",
            no_text,
            f'"{b}"',
            no_text,
            "indexed",
        )
    for name, column in (("X", "idx"), ("second", "second")):
        add(
            f"'AverageProtocolRate.' || capture || '.{name}'",
            "idx",
            no_text,
            column,
            no_text,
            "indexed",
        )
    zero = "CAST(0 AS BIGINT)"
    add(
        "'ProtocolDistribution.' || capture || '.' || bucket",
        zero,
        no_text,
        "n",
        no_text,
        "distribution",
    )
    add(
        "'ProtocolDistribution.' || capture || '.x'",
        zero,
        no_text,
        "buckets",
        no_text,
        "(SELECT DISTINCT capture, buckets FROM distribution)",
    )
    listed_name = "CASE listed_as WHEN 'src' THEN 'Source' ELSE 'Destination' END"
    role_name = "CASE role WHEN 'src' THEN 'Source' ELSE 'Destination' END"
    path = (
        f"'BehaviorOfTopIP.' || capture || 'BehaviorOf' || {listed_name}"
        f" || '.' || {role_name} || '.'"
    )
    data_name = "CASE role WHEN 'src' THEN 'sendData' ELSE 'receiveData' END"
    add(f"{path} || 'PacketNumber'", "rank - 1", "ip", "packets", no_text, "profile")
    add(f"{path} || {data_name}", "rank - 1", "ip", "bytes", no_text, "profile")
    for name, column in (
        ("FirstConnection", "first_connection"),
        ("LastConnection", "last_connection"),
    ):
        readable = READABLE.format(f"CAST(trunc({column}) AS BIGINT)")
        add(
            f"{path} || '{name}'",
            "rank - 1",
            "ip",
            no_number,
            readable,
            f"(SELECT * FROM profile WHERE {column} IS NOT NULL)",
        )
    add(f"{path} || 'Country'", "rank - 1", "ip", no_number, "country", "profile")
    add(
        f"'BehaviorOfTopIP.' || capture || '.' || {role_name} || '.Protocols'",
        zero,
        "ip || ' ' || protocol_name",
        "rate",
        no_text,
        "(SELECT capture, ip, role, protocol_name, count(*) AS rate FROM listed_rows"
        " GROUP BY capture, ip, role, protocol_name)",
    )
    add(
        f"{path} || 'Hours'",
        "rank - 1",
        "ip || ' ' || CAST(hour AS VARCHAR)",
        "rate",
        no_text,
        "(SELECT l.capture, l.listed_as, l.rank, l.ip, h.role, h.hour, h.rate FROM listed l"
        f" JOIN ({HOURS}) h ON h.capture = l.capture AND h.ip = l.ip)",
    )
    add(
        "'Map.' || capture || 'DS'", "rank - 1", "src || ' ' || dst", "value", no_text, "top"
    )
    add(
        "'Map.victimData'",
        "rank - 1",
        "dst",
        "value",
        no_text,
        "(SELECT * FROM top WHERE capture = 'attack')",
    )
    # A null coordinate gives no row.
    for name in ("longitude", "latitude"):
        add(
            f"'Map.geoData.{name}'",
            "v",
            "ip",
            name,
            no_text,
            f"(SELECT * FROM located WHERE {name} IS NOT NULL)",
        )
    traffic = f"count(*) AS packets, {BYTES} AS bytes, {PER_PROTOCOL}"
    return _with(
        PACKETS,
        BLOCKS,
        SECONDS,
        _bucketed(1, traffic),
        DISTRIBUTION,
        PAIRS,
        RANGES,
        TOP,
        ROLES,
        LISTED,
        LOCATED,
        PROFILE,
    ) + "\nUNION ALL\n".join(rows)


ALL_COLUMNS = "capture, src, dst, data_length, protocol_name, protocol_number, arrival_time"

HOURS_SEEN = f"""hours_seen AS (
  SELECT capture, second - ((second % {HOUR}) + {HOUR}) % {HOUR} AS second, count(*) AS value
  FROM seconds GROUP BY 1, 2)"""
# The first half of 2001:db0:: and of 2001:db8::, as numbers.
NET_DB0, NET_DB8 = (0x2001 << 48) + (0xDB0 << 32), (0x2001 << 48) + (0xDB8 << 32)
NETWORKS6 = f"""networks6 AS (
  SELECT CAST({NET_DB8} + n_nationkey * 4 * 65536 AS BIGINT) AS hi, CAST(0 AS BIGINT) AS lo,
         46 AS prefix_len, n_name AS country, CAST(NULL AS VARCHAR) AS city,
         n_nationkey * 1.5::DOUBLE AS latitude, 0.5::DOUBLE - n_nationkey * 1.5::DOUBLE AS longitude
  FROM nation
  UNION ALL
  SELECT CAST({NET_DB8} + (n_nationkey * 4 + 1) * 65536 AS BIGINT), 0, 48, n_name,
         'CITY_' || CAST(n_nationkey AS VARCHAR), n_nationkey * 2.5::DOUBLE, 0.5::DOUBLE - n_nationkey * 2.5::DOUBLE
  FROM nation
  UNION ALL
  SELECT CAST({NET_DB0} + r_regionkey * 8 * 4294967296 AS BIGINT), 0, 29, r_name, NULL,
         r_regionkey * 1.0::DOUBLE, 0.5::DOUBLE - r_regionkey * 1.0::DOUBLE
  FROM region)"""
# Hosts of both families with the network they are in, by the views' own numbers.
MIXED = """hosts AS (
  SELECT DISTINCT user_id % 128 AS net, user_id // 128 % 256 AS host, user_id % 16 AS last, user_id FROM events
), mixed AS (
  SELECT '2001:db8:' || lower(to_hex(net)) || '::' || lower(to_hex(host + 1)) AS ip,
         net // 4 AS nation, CAST(1 AS BIGINT) AS region,
         CASE WHEN net // 4 > 24 THEN 'region' WHEN net % 4 = 1 THEN 'city' ELSE 'nation' END AS kind
  FROM hosts
  UNION ALL
  SELECT '::FFFF:10.0.' || CAST(net AS VARCHAR) || '.' || CAST(host AS VARCHAR), net, 0, 'four' FROM hosts
  UNION ALL
  SELECT '2001:db' || lower(to_hex(last)) || ':ffff:0:0:0:0:1', 0, last // 8, 'region' FROM hosts
  UNION ALL SELECT '2001:db8::g', -1, 0, 'none' FROM hosts
  UNION ALL
  SELECT '10.0.' || CAST(user_id // 256 AS VARCHAR) || '.' || CAST(user_id % 256 AS VARCHAR), user_id // 256, 0, 'four'
  FROM hosts
), placed AS (
  SELECT DISTINCT m.ip, m.kind,
         CASE WHEN m.kind = 'region' THEN r.r_name WHEN m.kind <> 'none' THEN n.n_name END AS country,
         CASE WHEN m.kind = 'city' THEN 'CITY_' || CAST(n.n_nationkey AS VARCHAR) END AS city,
         CASE m.kind WHEN 'region' THEN r.r_regionkey * 1.0::DOUBLE WHEN 'nation' THEN n.n_nationkey * 1.5::DOUBLE
              WHEN 'city' THEN n.n_nationkey * 2.5::DOUBLE WHEN 'four' THEN n.n_nationkey * 3.5::DOUBLE END AS latitude
  FROM mixed m LEFT JOIN nation n ON n.n_nationkey = m.nation LEFT JOIN region r ON r.r_regionkey = m.region)"""


ORACLE: dict[str, str] = {
    "packets_scan": _packets(f"SELECT {ALL_COLUMNS} FROM packets"),
    "packets_parse": _packets(f"SELECT {ALL_COLUMNS} FROM packets"),
    "packets_text": _packets(f"SELECT {ALL_COLUMNS} FROM packets"),
    "packets_rejects": """SELECT reason, count(*) AS n FROM events
CROSS JOIN (VALUES ('arity'), ('arity'), ('data_length'), ('arrival_time')) r(reason)
GROUP BY reason""",
    "packets_text_files": _packets(f"SELECT {ALL_COLUMNS} FROM packets"),
    "rejected_lines": _with(PACKETS)
    + """SELECT capture, reason, src, fields FROM packets CROSS JOIN
(VALUES ('arity', 5), ('arity', 8), ('data_length', 6), ('arrival_time', 6)) r(reason, fields)""",
    "capture_union": _packets(
        "\nUNION ALL\n".join(
            f"SELECT {ALL_COLUMNS} FROM packets WHERE capture = '{c}'" for c in CAPTURES
        )
    ),
    "typed_rejects": _packets(
        "SELECT CASE WHEN data_length % 7 = 0 THEN 'data_length' ELSE 'arrival_time' END AS reason,"
        " count(*) AS n FROM packets WHERE data_length % 7 = 0 OR data_length % 5 = 0 GROUP BY 1"
    ),
    "geo_blocks": _with(BLOCKS) + "SELECT * FROM blocks",
    "geo_networks": _with(BLOCKS)
    + """SELECT ip_from // (1 << (32 - prefix_len)) * (1 << (32 - prefix_len)) AS ip_from,
ip_from // (1 << (32 - prefix_len)) * (1 << (32 - prefix_len)) + (1 << (32 - prefix_len)) - 1 AS ip_to,
prefix_len, country, city, latitude, longitude FROM blocks
WHERE latitude IS NOT NULL AND ip_from - 167772160 < 256""",
    "geo_networks6": _with(NETWORKS6)
    + "SELECT hi, lo, prefix_len, country, city, latitude, longitude FROM networks6",
    "geo_lookup_mixed": _with(MIXED)
    + """SELECT ip, country IS NOT NULL AS found, coalesce(country, 'not found') AS country,
CASE WHEN country IS NULL THEN 'not found' ELSE city END AS city,
coalesce(latitude, 0.0::DOUBLE) AS latitude,
CASE WHEN country IS NULL THEN 0.0::DOUBLE ELSE 0.5::DOUBLE - latitude END AS longitude
FROM placed""",
    "block_rejects": _with(BLOCKS)
    + """SELECT 'network' AS reason, count(*) AS n FROM blocks
WHERE latitude IS NOT NULL AND ip_from - 167772160 >= 256
UNION ALL SELECT 'range', count(*) FROM blocks WHERE ip_from % 3 = 0""",
    "project_endpoints": _packets("SELECT src, dst FROM packets"),
    "filter_src": _packets(f"SELECT {ALL_COLUMNS} FROM packets WHERE src = '{FILTER_SRC}'"),
    "filter_dst": _packets(f"SELECT {ALL_COLUMNS} FROM packets WHERE dst = '{FILTER_DST}'"),
    "epoch_second": _with(PACKETS, SECONDS) + "SELECT capture, second FROM seconds",
    "readable_time": _with(PACKETS, SECONDS)
    + f"SELECT capture, {READABLE.format('second')} AS readable FROM seconds",
    "protocol_bucket": _packets(
        f"SELECT capture, protocol_name, {BUCKET} AS bucket FROM packets"
    ),
    "protocol_map": _with(PACKETS, DISTRIBUTION)
    + """SELECT capture, bucket, n FROM distribution
UNION ALL SELECT DISTINCT capture, 'x', buckets FROM distribution""",
    "top_talkers_array": _packets(
        f"""SELECT capture,
       '[' || string_agg('{{"' || ip || '":' || CAST(n AS VARCHAR) || '}}', ',' ORDER BY rank)
       || ']' AS hosts
FROM (SELECT *, row_number() OVER (PARTITION BY capture ORDER BY n DESC, ip) AS rank
      FROM (SELECT capture, src AS ip, count(*) AS n FROM packets GROUP BY capture, src))
WHERE rank <= {TOP_HOSTS} GROUP BY capture"""
    ),
    "count_by_src": _grouped("src", "count(*)"),
    "count_by_dst": _grouped("dst", "count(*)"),
    "bytes_by_src": _grouped("src", BYTES),
    "bytes_by_dst": _grouped("dst", BYTES),
    "protocol_distribution": _with(PACKETS, DISTRIBUTION) + "SELECT * FROM distribution",
    "packets_per_second": _series("count(*)", 1),
    "packets_per_hour": _series("count(*)", HOUR),
    "bytes_per_second": _series(BYTES, 1),
    "bytes_per_hour": _series(BYTES, HOUR),
    "protocol_per_second": _protocols(1),
    "protocol_per_hour": _protocols(HOUR),
    "packet_rate_summary": _summary("count(*)", 1),
    "byte_rate_summary": _summary(BYTES, 1),
    "packet_rate_summary_hourly": _summary("count(*)", HOUR),
    "byte_rate_summary_hourly": _summary(BYTES, HOUR),
    "packets_per_hour_filled": _with(PACKETS, SECONDS, HOURS_SEEN)
    + f"""SELECT g.capture, g.second, row_number() OVER (PARTITION BY g.capture ORDER BY g.second) - 1 AS idx,
coalesce(h.value, 0) AS value
FROM (SELECT capture, unnest(generate_series(min(second), max(second), {HOUR})) AS second
      FROM hours_seen GROUP BY capture) g
LEFT JOIN hours_seen h ON h.capture = g.capture AND h.second = g.second""",
    "packet_rate_summary_idle": _with(PACKETS, SECONDS)
    + """SELECT capture, round(sum(n)::DOUBLE / (max(second) - min(second) + 1), 6) AS average,
CASE WHEN count(*) < max(second) - min(second) + 1 THEN 0 ELSE min(n) END AS minimum, max(n) AS maximum
FROM (SELECT capture, second, count(*) AS n FROM seconds GROUP BY capture, second) GROUP BY capture""",
    "kept_pair_totals": _packets(
        f"SELECT capture, src, dst, count(*) AS n, {BYTES} AS bytes FROM packets GROUP BY capture, src, dst"
    ),
    "streamed_traffic": _with(PACKETS, SECONDS)
    + f"""SELECT capture, second, count(*) AS packets, {BYTES} AS bytes, {PER_PROTOCOL}
FROM seconds GROUP BY capture, second""",
    "written_top_src": _top_hosts("src", "count(*)"),
    "total_bytes": _packets(f"SELECT capture, {BYTES} AS total FROM packets GROUP BY capture"),
    "second_index": _with(PACKETS, SECONDS, _bucketed(1, "count(*) AS value"))
    + "SELECT capture, second, idx FROM indexed",
    "host_profile": _with(PACKETS, BLOCKS, ROLES, LISTED, LOCATED, PROFILE)
    + "SELECT *, "
    + READABLE.format("CAST(trunc(first_connection) AS BIGINT)")
    + " AS first_text FROM profile",
    "host_protocols": _with(PACKETS, ROLES, LISTED)
    + """SELECT capture, ip, role, protocol_name, count(*) AS rate
FROM listed_rows GROUP BY capture, ip, role, protocol_name""",
    "pair_counts": _with(PACKETS, PAIRS) + "SELECT capture, src, dst, n FROM pairs",
    "pair_range": _with(PACKETS, PAIRS, RANGES)
    + "SELECT capture, highest, lowest, highest - lowest AS spread FROM ranges",
    "top_src_packets": _top_hosts("src", "count(*)"),
    "top_dst_packets": _top_hosts("dst", "count(*)"),
    "top_src_bytes": _top_hosts("src", BYTES),
    "top_dst_bytes": _top_hosts("dst", BYTES),
    "top_pairs": _with(PACKETS, PAIRS, RANGES, TOP) + "SELECT * FROM top",
    "top_victims": _with(PACKETS, PAIRS, RANGES, TOP)
    + "SELECT rank, dst, value FROM top WHERE capture = 'attack'",
    "all_endpoints": _packets("SELECT src AS ip FROM packets UNION ALL SELECT dst FROM packets"),
    "distinct_ips": _packets("SELECT src AS ip FROM packets UNION SELECT dst FROM packets"),
    "top_host_packets": _with(PACKETS, ROLES, LISTED)
    + """SELECT capture, ip, role, count(*) AS packets FROM roles
WHERE (capture, ip) IN (SELECT (capture, ip) FROM listed WHERE listed_as = 'src')
GROUP BY capture, ip, role""",
    "geo_lookup": _located("ip, found, country, city, latitude, longitude"),
    "geo_lookup_kept": _located("ip, found, country, city, latitude, longitude"),
    "geo_country": _located("ip, country"),
    "geo_city": _located("ip, city"),
    "geo_location": _located("ip, latitude, longitude"),
    "geo_map": _located("ip, longitude, latitude"),
    "host_hours": _with(PACKETS, ROLES, LISTED) + HOURS,
    "host_peer_countries": _with(PACKETS, BLOCKS, ROLES, LISTED, LOCATED)
    + """SELECT l.capture, l.ip, l.role, g.country, count(*) AS rate
FROM listed_rows l JOIN located g ON g.ip = l.peer
GROUP BY l.capture, l.ip, l.role, g.country""",
    "top_countries": _with(PACKETS, BLOCKS, LOCATED)
    + """SELECT capture, rank, country, n FROM (
  SELECT *, row_number() OVER (PARTITION BY capture ORDER BY n DESC, country) AS rank
  FROM (SELECT p.capture, g.country, count(*) AS n
        FROM packets p JOIN located g ON g.ip = p.src GROUP BY p.capture, g.country))
WHERE rank <= 10""",
    "report_values": _report_values(),
}
