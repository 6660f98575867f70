"""Every query of the library against its SQL, on the smallest data folder."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import check
from __spark_entry__ import entry
from titleloom.queries import all_oracles, all_queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no data folder")


@pytest.fixture(scope="module")
def base():
    connection = duckdb.connect()
    for table in check.TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


def test_the_flagship_query(spark):
    assert entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(all_oracles()) == set(all_queries())


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query_equals_its_sql(spark, base, name):
    frame = all_queries()[name](spark, FOLDER)
    found = check._sorted_rows(frame.columns, [tuple(r) for r in frame.collect()])
    result = base.execute(all_oracles()[name])
    assert found == check._sorted_rows([d[0] for d in result.description], result.fetchall())
