"""Training-data queries that SQL can express, against their SQL on whole tables."""

from pathlib import Path

import duckdb
import pytest

from webtally.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, sf_dir, name):
    db = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        db.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    got = queries.queries()[name](spark, sf_dir)
    want = db.sql(queries.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=str)
    at = [want.columns.index(c) for c in columns]
    assert rows == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str)
