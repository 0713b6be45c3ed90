"""Every catalogue query against its SQL, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from dayloom.plans.bindings import ORACLE_SQL, QUERIES
from tests.conftest import DATA


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
    wanted = duck.execute(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert rows == sorted(map(repr, wanted))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
