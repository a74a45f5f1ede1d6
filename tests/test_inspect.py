"""Inspection of stored rows."""

import json

import pytest
from pyspark.sql import functions as F

from relaymill.functions import audit
from relaymill.operators import inspect
from relaymill.schema import PROCESSED
from tests.conftest import T0


def row(id_, flow=1, history=(), **cells):
    entries = [tuple(e.get(k) for k in (*audit.AUDIT_KEYS, "other")) for e in history]
    base = dict(id=id_, position=0, message_id=f"m{id_}", flow_id=flow, item_id=id_ % 3, initial_data="d",
                counter_value=None, metric_value=None, examined_status=None, verified_by=None,
                history_trail=entries, raw_payload="{}", created_at=T0)
    return tuple((base | cells)[n] for n in PROCESSED.names)


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([row(i, 1 + i % 2) for i in range(1, 21)], PROCESSED).repartition(3)


def test_latest(rows):
    assert [r.id for r in inspect.latest(rows, 5).collect()] == [20, 19, 18, 17, 16]
    assert [r.id for r in inspect.latest(rows).collect()] == list(range(20, 10, -1))
    assert inspect.latest(rows, 5).columns == list(inspect.SUMMARY)


def test_position_orders_rows_of_one_request(spark):
    cells = [(7, p, f) for p in (1, 2, 3) for f in (1, 2)]
    made = [row(i, f, position=p, message_id=f"{p}-{f}", item_id=p) for i, p, f in cells]
    rows = spark.createDataFrame([*made, row(8)], PROCESSED).repartition(3)
    newest = inspect.latest(rows, 4, ("message_id",)).collect()
    assert [r.message_id for r in newest] == ["m8", "3-2", "3-1", "2-2"]
    assert inspect.latest_of_flow(rows.where("id = 7"), 1).first().message_id == "3-1"


def test_latest_of_flow_and_lookups(rows):
    assert [r.message_id for r in inspect.latest_of_flow(rows, 1).collect()] == ["m20"]
    assert [r.message_id for r in inspect.latest_of_flow(rows, 2).collect()] == ["m19"]
    assert inspect.latest_of_flow(rows.where("flow_id = 1"), 2).count() == 0
    assert [r.id for r in inspect.by_message(rows, "m7").collect()] == [7]
    assert {r.id for r in inspect.by_flow_item(rows, 1, 0).collect()} == {6, 12, 18}
    assert inspect.created_between(rows, "2025-08-20", "2025-08-21").count() == 20
    assert inspect.created_between(rows, "2025-08-21", "2025-08-22").count() == 0


def test_step_lines(spark):
    history = [
        {"stage": "a", "timestamp": "t", "modification": "m", "status": "s"},
        {"stage": "b", "timestamp": "t", "modification": "", "status": "s"},
        {"stage": "c", "timestamp": "t", "modification": "", "status": "", "database_action": ""},
        {"stage": "d", "database_action": "x"},
        {},
    ]
    steps = inspect.audit_steps(spark.createDataFrame([row(1, history=history)], PROCESSED))
    assert [(r.step, r.description, r.line) for r in steps.orderBy("step").collect()] == [
        (1, "m", "[a] at t: m"),
        (2, "s", "[b] at t: s"),
        (3, "", "[c] at t: "),
        (4, "x", "[d] at None: x"),
        (5, None, "[None] at None: None"),
    ]


def test_step_counts_and_pretty_text(spark):
    data = [row(1, history=[{"stage": "é"}, {"other": '{"k":[1]}'}]), row(2)]
    table = spark.createDataFrame(data, PROCESSED)
    assert [r.steps for r in inspect.audit_step_counts(table).orderBy("id").collect()] == [2, 0]
    nothing = table.withColumn("history_trail", F.lit(None).cast(PROCESSED["history_trail"].dataType))
    assert {r.steps for r in inspect.audit_step_counts(nothing).collect()} == {0}
    text = inspect.detail(table, 1).where("message_id = 'm1'").first().audit_trail
    assert json.loads(text) == [{"stage": "é"}, {"k": [1]}] and "\n" in text
    assert inspect.detail(table, 1).where("message_id = 'm2'").first().audit_trail == "[ ]"


def test_copies(rows):
    assert inspect.compare_copies({"a": rows, "b": rows, "c": rows}).count() == 0
    other = rows.where("id != 4").withColumn("counter_value", F.when(F.col("id") == 5, 1))
    found = inspect.compare_copies({"a": rows, "b": other, "c": rows}).orderBy("id", "in_b").collect()
    assert [(r.id, r.counter_value, r.in_a, r.in_b, r.in_c) for r in found] == [
        (4, None, 1, 0, 1), (5, None, 1, 0, 1), (5, 1, 0, 1, 0),
    ]
    twice = rows.union(rows.where("id = 1"))
    (r,) = inspect.compare_copies({"a": rows, "b": twice}).collect()
    assert (r.id, r.in_a, r.in_b) == (1, 1, 2)
    assert inspect.compare_latest({"a": rows, "b": other}, 5).count() == 0
    assert inspect.compare_latest({"a": rows, "b": other.where("id < 20")}, 5).count() == 2
