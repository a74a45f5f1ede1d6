"""The plans are the intended ones."""

import re

import pytest
from pyspark.sql import functions as F

from relaymill.operators import ingest, inspect, messages as M, persist
from relaymill.plans import catalog, flows
from relaymill.schema import QUEUE_RECORD, REQUEST, ROUTES
from relaymill.session import EXECUTION_SETTINGS, SEMANTIC_SETTINGS, configure, work_dir


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Requests and queue records as files, so that scans show in the plans."""
    root = tmp_path_factory.mktemp("plans")
    spark.createDataFrame([], REQUEST).write.parquet(f"{root}/requests")
    spark.createDataFrame([], QUEUE_RECORD).write.parquet(f"{root}/records")
    return spark.read.parquet(f"{root}/requests"), spark.read.parquet(f"{root}/records")


def test_from_request_to_table_row_is_one_narrow_pass(stored):
    made = ingest.direct_messages(stored[0])
    text = plan(M.accepted(flows.finish(made, None, F.col("clock"))))
    assert "Exchange" not in text and "Python" not in text
    assert text.count("FileScan") == 1


def test_upsert_is_the_only_shuffle_and_aggregates_before_it(stored):
    rows = M.accepted(flows.finish(ingest.direct_messages(stored[0]), None, F.col("clock")))
    text = plan(persist.upsert(rows))
    assert text.count("Exchange") == 1 and text.count("FileScan") == 1
    before = text[text.index("Exchange"):]
    assert "partial_min_by" in before and "partial_max_by" in before


@pytest.mark.parametrize("queue", [q for route in ROUTES.values() for q in route[:-1]])
def test_documents_are_parsed_once_per_hop(stored, queue):
    out = M.accepted(flows.forward(stored[1], queue, F.col("clock")).withColumn("x", F.lit(1)))
    # one parse of every document; the other one is behind the test for "]]"
    assert optimized(out).count("parseJson") <= 2
    assert "Exchange" not in plan(out)


def test_unused_documents_are_not_written(stored):
    rows = flows.finish_records(stored[1], ROUTES[1][0], F.col("clock")).drop("raw_payload")
    assert "map_filter" not in optimized(rows) and "mapfilter" not in optimized(rows)


def test_latest_keeps_n_rows_per_task(spark, tmp_path):
    spark.createDataFrame([], catalog.T.PROCESSED).write.parquet(f"{tmp_path}/t")
    rows = spark.read.parquet(f"{tmp_path}/t")
    text = plan(inspect.latest(rows))
    assert "TakeOrderedAndProject" in text and "Exchange" not in text
    assert "history_trail" not in re.search(r"ReadSchema: .*", text)[0]
    text = plan(inspect.latest_of_flow(rows, 1))
    assert "TakeOrderedAndProject" in text
    assert "EqualTo(flow_id,1)" in text
    text = plan(inspect.by_flow_item(rows, 1, 7))
    assert "EqualTo(flow_id,1)" in text and "EqualTo(item_id,7)" in text
    assert "EqualTo(message_id,x)" in plan(inspect.by_message(rows, "x"))
    text = plan(inspect.created_between(rows, "2024-01-01", "2024-01-02"))
    assert "GreaterThanOrEqual(created_at" in text and "LessThan(created_at" in text


def test_copies_are_compared_in_one_shuffle(spark, tmp_path):
    spark.createDataFrame([], catalog.T.PROCESSED).write.parquet(f"{tmp_path}/t")
    rows = spark.read.parquet(f"{tmp_path}/t")
    text = plan(inspect.compare_copies({"a": rows, "b": rows, "c": rows}))
    assert text.count("Exchange") == 1 and "partial_sum" in text
    assert "raw_payload" not in text


def test_settings_and_shared_folder(spark):
    configure(spark)
    for key, value in (SEMANTIC_SETTINGS | EXECUTION_SETTINGS).items():
        assert spark.conf.get(key) == value
    assert work_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
