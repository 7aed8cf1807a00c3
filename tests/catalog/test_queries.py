"""Every catalog query against its SQL on the smallest tables."""

import duckdb
import pytest

from basalt.plans import catalog_queries as cq

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    say = lambda v: str(int(v)) if isinstance(v, float) and v == int(v) else str(v)
    return sorted(tuple(say(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(cq.SQL))
def test_equals_sql(spark, duck, name):
    got = cq.queries()[name](spark, SF)
    want = duck.sql(cq.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(want.fetchall(), want.columns)


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(cq.SQL) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
