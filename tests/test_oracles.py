"""Queries against their SQL in DuckDB, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from lorewell.plans.queries import SQL

DIR = "/root/testdata/sf0.001"
SLOW = {"topk_collab_events", "collab_similarity"}

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    show = lambda x: "None" if x is None else f"{x:.9g}" if isinstance(x, float) else str(x)
    return sorted(columns), sorted(tuple(show(r[k]) for k in order) for r in data)


@pytest.mark.parametrize("name", sorted(set(SQL) - SLOW))
def test_oracle(spark, duck, name):
    df = entry.queries()[name](spark, DIR)
    got = duck.execute(SQL[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([c[0] for c in got.description], got.fetchall())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
