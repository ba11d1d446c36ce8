"""Every query with SQL against DuckDB at the smallest scale, and the entry point."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from terrane.plans import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for p in Path(FOLDER).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return connection


def _sorted(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(columns), sorted(str(tuple(r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_its_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, FOLDER)
    want = duck.execute(catalog.ORACLE[name])
    assert _sorted(got.columns, [tuple(r) for r in got.collect()]) == _sorted([d[0] for d in want.description], want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
