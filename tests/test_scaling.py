"""What one task takes on must not grow with the input."""

import datetime as dt

from pyspark.sql import functions as F

from relaymill.functions import splice
from relaymill.plans import catalog, fixtures
from relaymill.schema import ROUTES
from relaymill.session import LEAST_PARTITIONS, configure
from relaymill.sources import queues

INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def _events(spark, folder, n):
    at = dt.datetime(2024, 1, 1)
    rows = [(i, at, 1, ("view", "error")[i % 2], 1.5, '{"k": 3}') for i in range(n)]
    layout = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, layout).coalesce(1).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_tasks_are_bounded_by_rows(spark, tmp_path, monkeypatch):
    sf = _events(spark, tmp_path, 200)
    monkeypatch.setattr(fixtures, "ROWS_PER_TASK", 10)
    events = fixtures.events(spark, sf)
    assert events.count() == 200
    assert events.rdd.getNumPartitions() == 20
    assert fixtures.spread(events, "seq").rdd.getNumPartitions() == 20
    assert fixtures.parts(spark, sf) == 20 and fixtures.tasks_for(0) == 1


def test_shuffles_start_with_many_partitions(spark):
    assert int(configure(spark).conf.get(INITIAL)) >= LEAST_PARTITIONS
    before = spark.conf.get(INITIAL)
    try:
        spark.conf.set(INITIAL, "5000")
        assert configure(spark).conf.get(INITIAL) == "5000"
    finally:
        spark.conf.set(INITIAL, before)


def test_buckets_and_queue_files_go_with_the_events(spark, tmp_path, monkeypatch):
    sf = _events(spark, tmp_path, 200)
    monkeypatch.setattr(fixtures, "ROWS_PER_TASK", 10)
    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert catalog._bucketed(spark, sf).buckets == max(few, 20)
    root = f"{tmp_path}/root"
    catalog._fill_first_queues(spark, sf, root)
    for route in ROUTES.values():
        found = queues.consume(spark, root, route[0])
        assert found.select(F.input_file_name()).distinct().count() > spark.sparkContext.defaultParallelism
    assert catalog._files_at_once(spark, 4) == 3
    assert catalog._files_at_once(spark, 10_000) == 4 * spark.sparkContext.defaultParallelism


def test_the_end_of_an_array_is_looked_for_once(spark):
    rows = spark.createDataFrame([('{"history": [1, {"a": [2]}], "b": 1}',)], "body string")
    rows = rows.select(splice.cut(F.col("body")).alias("pieces"))
    rows = rows.withColumn("at", splice.place_of(F.col("pieces"), "history"))
    end = rows.select("pieces", splice.end_of_array(F.col("pieces"), F.col("at")).alias("end"))
    added = splice.pasted(splice.with_element(F.col("pieces"), F.col("end"), F.lit("3")))
    assert end.select(added).first()[0] == '{"history": [1, {"a": [2]},3], "b": 1}'
    plan = end._jdf.queryExecution().analyzed().toString().splitlines()[0]
    assert plan.count("aggregate(") <= 3
