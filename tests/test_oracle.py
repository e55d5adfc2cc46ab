"""Every registered query against its SQL counterpart, on whole tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract

# The training-data queries are tested where their subpackage is.
QUERIES = {n: q for n, q in contract.queries().items() if n not in contract.TRAINING_DATA_QUERIES}
SQL = {n: q for n, q in contract.oracle_sql().items() if n not in contract.TRAINING_DATA_SQL}


@pytest.fixture(scope="session")
def db(sf_dir):
    connection = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        connection.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def _sorted_rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    picked = [tuple(row[i] for i in order) for row in rows]
    return sorted(picked, key=lambda row: [(v is None, str(type(v)), v) for v in row])


# DuckDB types of the Spark types in the results
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, db, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    want = db.sql(SQL[name])
    assert {c: TYPES[t] for c, t in got.dtypes} == dict(zip(want.columns, map(str, want.types)))
    got_rows = _sorted_rows([tuple(r) for r in got.collect()], got.columns)
    want_rows = _sorted_rows(want.fetchall(), want.columns)
    assert got_rows == want_rows


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert len(rows) == 10 and rows[0].countv >= rows[9].countv > 0
