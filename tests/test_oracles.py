"""Every query with SQL is held against DuckDB on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from girder.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in Path(SF).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_oracle(spark, duck, name):
    made = QUERIES[name](spark, SF)
    cursor = duck.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(made.columns)
    order = [columns.index(c) for c in sorted(columns)]
    wanted = sorted(repr(tuple(row[k] for k in order)) for row in cursor.fetchall())
    assert sorted(repr(tuple(r)) for r in made.select(*sorted(columns)).collect()) == wanted
