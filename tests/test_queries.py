"""Every registered query against its SQL on the smallest data."""

import math

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def con():
    db = duckdb.connect()
    for name in TABLES.split():
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return db


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (math.isnan(a) and math.isnan(b))
    return a == b


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    df = queries()[name](spark, FOLDER)
    names = sorted(df.columns)
    mine = sorted((tuple(r) for r in df.select(*names).collect()), key=repr)
    assert mine
    if name not in oracle_sql():
        return
    got = con.execute(oracle_sql()[name])
    heads = [d[0] for d in got.description]
    order = sorted(range(len(heads)), key=lambda i: heads[i])
    other = sorted((tuple(r[i] for i in order) for r in got.fetchall()), key=repr)
    assert names == sorted(heads)
    assert len(mine) == len(other)
    assert all(same(a, b) for x, y in zip(mine, other) for a, b in zip(x, y))


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())
