"""Every registered query against its SQL in DuckDB, on whole tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from wiretally.plans import catalog, oracle

SF_DIR = "/root/testdata/sf0.01"
QUERIES, ORACLE = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for path in sorted(Path(SF_DIR).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _sorted(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    arranged = [tuple(row[i] for i in order) for row in rows]
    return sorted(arranged, key=lambda r: tuple((v is None, str(type(v)), v) for v in r))


TYPE_NAMES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, duck, name):
    result = QUERIES[name](spark, SF_DIR)
    cursor = duck.execute(ORACLE[name])
    columns = [c[0] for c in cursor.description]
    kinds = {c[0]: str(c[1]) for c in cursor.description}
    expected = _sorted(columns, cursor.fetchall())

    assert sorted(result.columns) == sorted(columns)
    assert {c: TYPE_NAMES[t] for c, t in result.dtypes} == kinds
    actual = _sorted(result.columns, [tuple(r) for r in result.collect()])
    assert len(actual) == len(expected) > 0
    for a, e in zip(actual, expected, strict=True):
        assert a == e
        assert not any(isinstance(v, float) and math.copysign(1, v) < 0 == v for v in a)


def test_every_packet_query_has_an_oracle():
    assert set(catalog.QUERIES) == set(oracle.ORACLE)
