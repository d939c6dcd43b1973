"""Every query of the document engine against its SQL."""

import os

import duckdb
import pytest

from parchmill.plans.registry import ORACLES, QUERIES

SF = os.environ.get("PARCHMILL_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(repr(tuple(r[k] for k in order)) for r in data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, db, name):
    df = QUERIES[name](spark, SF)
    answer = db.execute(ORACLES[name])
    columns = [d[0] for d in answer.description]
    expected = answer.fetchall()
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, expected)
    assert expected


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
