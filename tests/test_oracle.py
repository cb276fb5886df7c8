"""Every query with SQL gives the rows of that SQL, at the smallest scale."""

from __future__ import annotations

import math

import duckdb
import pytest

from mosaiq.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def database(data):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/sf0.001/{t}.parquet'")
    return c


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    return f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, database, name):
    df = QUERIES[name](spark, f"{data}/sf0.001")
    got = database.execute(ORACLES[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(range(len(names)), key=names.__getitem__)
    want = sorted(tuple(cell(r[i]) for i in order) for r in got.fetchall())
    columns = sorted(df.columns)
    assert sorted(tuple(cell(r[c]) for c in columns) for r in df.collect()) == want


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
