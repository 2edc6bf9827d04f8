"""Every registered query against its DuckDB SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as registry

SF = "/root/testdata/sf0.001"
TABLES = ("customer", "part", "orders", "lineitem")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


# queries of the llm subpackage, where it is present, have tests of their own
OWN = [name for name in registry.queries() if name not in registry._llm("queries")]


def test_registry_is_complete():
    assert set(OWN) == set(registry.oracle_sql()) - set(registry._llm("oracle_sql"))


def test_entry(spark):
    assert len(registry.entry(spark).collect()) == 50


@pytest.mark.parametrize("name", OWN)
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = [tuple(row[c] for c in columns) for row in df.collect()]
    cursor = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    expected = [tuple(row[names.index(c)] for c in columns) for row in cursor.fetchall()]
    assert sorted(map(repr, found)) == sorted(map(repr, expected))
