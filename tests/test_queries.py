"""Every registered query against its SQL on the smallest given tables."""

import os

import pytest

import __spark_entry__ as entry
from relaymill.plans import catalog, oracle

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


def canonical(columns, rows):
    order = sorted(columns)
    return order, sorted(tuple(repr(row[columns.index(c)]) for c in order) for row in rows)


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(oracle.statements())
    assert set(catalog.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    result = entry.queries()[name](spark, SF)
    mine = canonical(result.columns, [tuple(r) for r in result.collect()])
    answer = duck.execute(entry.oracle_sql()[name])
    theirs = canonical([c[0] for c in answer.description], answer.fetchall())
    assert mine == theirs
    assert mine[1], "an empty result shows nothing"


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 10
    assert [r.id for r in rows] == sorted((r.id for r in rows), reverse=True)
