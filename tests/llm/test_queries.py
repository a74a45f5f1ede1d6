"""The queries that have SQL, against it, and the registration of all."""

import duckdb
import pytest

import __spark_entry__ as entry
from relaymill.llm.queries import queries
from relaymill.llm.statements import statements

SF = "/root/testdata/sf0.001"


def test_all_are_registered():
    names = entry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13
    assert "pipeline" in names and set(statements()) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(statements()))
def test_query_equals_sql(spark, name):
    connection = duckdb.connect()
    for name_ in ("documents", "conversations"):
        connection.execute(f"CREATE VIEW {name_} AS SELECT * FROM '{SF}/{name_}.parquet'")
    answer = connection.execute(statements()[name])
    columns = [c[0] for c in answer.description]
    result = queries()[name](spark, SF)
    assert sorted(result.columns) == sorted(columns)
    mine = sorted(tuple(map(repr, r)) for r in result.select(*columns).collect())
    assert mine == sorted(tuple(map(repr, r)) for r in answer.fetchall())
