"""The bucketed table: what moves, and what a reader sees."""

import pytest
from pyspark.sql import functions as F

from relaymill.operators import persist
from relaymill.schema import PROCESSED
from relaymill.sources.bucketed import BucketedTable
from relaymill.sources.table import merge_statement
from tests.conftest import T0

LAYOUT = "seq long, position long, " + ", ".join(
    f"{f.name} {f.dataType.simpleString()}" for f in PROCESSED.fields if f.name not in ("id", "position")
)


def deliveries(spark, *cells):
    rows = []
    for seq, message_id, counter, text in cells:
        base = dict(seq=seq, position=0, message_id=message_id, flow_id=1, item_id=seq % 5, initial_data=text,
                    counter_value=counter, metric_value=None, examined_status=None, verified_by=None,
                    history_trail=[], raw_payload="{}", created_at=T0)
        rows.append(tuple(base.values()))
    return spark.createDataFrame(rows, LAYOUT)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def cells(rows):
    """All columns are read, the nested ones as well."""
    found = rows.collect()
    assert all(r.history_trail == [] and r.raw_payload == "{}" for r in found)
    return sorted((r.id, r.message_id, r.counter_value, r.initial_data) for r in found)


@pytest.fixture
def table(spark, tmp_path):
    return BucketedTable(spark, f"rm_{tmp_path.name.replace('-', '_')}.processed", f"{tmp_path}/t", buckets=6)


def test_what_is_stored_is_never_shuffled(spark, table):
    table.upsert(deliveries(spark, *[(i, f"m{i % 40}", i, "x") for i in range(100)]))
    table.merge()
    table.upsert(deliveries(spark, (200, "m1", 5, "y")))
    for merged in (table.states(), table.scan()):
        text = plan(merged)
        assert "Exchange" not in text and text.count("FileScan") == 2 and text.count("Bucketed: true") == 2
        assert "Union" not in text
    assert plan(table.by_message("m1")).count("SelectedBucketsCount: 1 out of 6") == 2
    # files hold one bucket each: as many tasks as buckets
    assert spark.table(table._part("base", 2)).groupBy("_key").count().rdd.getNumPartitions() == 6


def test_upserts_and_merges_equal_one_upsert(spark, table):
    parts = [
        [(i, f"m{i % 7}", i, f"t{i}") for i in range(low, low + 20)] for low in (0, 20, 40)
    ] + [[(60, "m3", None, "late"), (3, "m3", 99, "early again")]]
    whole = deliveries(spark, *[c for part in parts for c in part])
    assert table.version() == 0
    for i, part in enumerate(parts):
        table.upsert(deliveries(spark, *part))
        table.upsert(deliveries(spark, *part))  # delivered again
        if i % 2:
            assert table.merge() == 1 + (i + 1) // 2
    assert cells(table.scan()) == cells(persist.upsert(whole))
    assert spark.table(table.name).columns == ["message_key", *PROCESSED.names]
    assert table.by_message("m3").first().counter_value is None
    names = {t.name for t in spark.catalog.listTables(table.name.split(".")[0])}
    assert names == {"processed"} | {f"processed_{p}_v{v}" for p in ("base", "changes") for v in (2, 3)}


def test_merging_when_due(spark, table):
    table.upsert(deliveries(spark, *[(i, f"m{i}", i, "x") for i in range(40)]))
    assert table.merge_if_due() and not table.merge_if_due()
    table.upsert(deliveries(spark, *[(100 + i, f"m{i}", i, "y") for i in range(5)]))
    assert not table.merge_if_due() and table.version() == 2
    table.upsert(deliveries(spark, *[(200 + i, f"n{i}", i, "z") for i in range(30)]))
    assert table.merge_if_due() and table.version() == 3 and table.scan().count() == 70


SPELLINGS = [(1, "Key-1", 1, "first"), (2, "KEY-1  ", 2, "second"), (3, "key-1", 3, "third"), (4, " key-1", 4, "other")]


def test_keys_under_a_collation(spark, tmp_path):
    name = f"rmc_{tmp_path.name.replace('-', '_')}.processed"
    table = BucketedTable(spark, name, f"{tmp_path}/t", buckets=3, collation="UNICODE_CI_RTRIM")
    for cell in SPELLINGS:
        table.upsert(deliveries(spark, cell))
    wanted = [(1, "Key-1", 3, "first"), (4, " key-1", 4, "other")]
    assert cells(table.scan()) == wanted
    table.merge()
    assert cells(table.scan()) == wanted == cells(persist.upsert(deliveries(spark, *SPELLINGS), "UNICODE_CI_RTRIM"))
    assert cells(table.by_message("KEY-1 ")) == wanted[:1]


@pytest.mark.parametrize("collation", ["UTF8_LCASE", "UNICODE_CI", "UNICODE_CI_RTRIM", "UTF8_LCASE_RTRIM", "UNICODE_RTRIM"])
def test_normal_keys_are_equal_where_the_collation_says_so(spark, collation):
    ids = ["abc", "ABC", "abc ", "aBc   ", " abc", "ÄÖ", "äö", "ä", "a", "", " ", "x-1", "X-1", "\tabc"]
    rows = spark.createDataFrame([(i,) for i in ids], "id string")
    pairs = rows.alias("x").crossJoin(rows.alias("y"))
    key = {s: persist.normal_key(F.col(f"{s}.id"), collation) for s in "xy"}
    said = F.collate("x.id", collation) == F.collate("y.id", collation)
    assert pairs.where(said != (key["x"] == key["y"])).count() == 0


def test_accents_are_refused_and_merge_names_the_key(spark):
    with pytest.raises(ValueError):
        persist.normal_key(F.lit("x"), "UNICODE_AI")
    assert "ON t.message_id = s.message_id" in merge_statement("t", "b")
    assert "ON lower(upper(rtrim(t.message_id))) = lower(upper(rtrim(s.message_id)))" in merge_statement(
        "t", "b", "UNICODE_CI_RTRIM"
    )
