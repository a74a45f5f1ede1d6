"""Streams give what the batch gives, also when they stop and resume."""

import json

import pytest
from pyspark.sql import functions as F

from relaymill.operators import ingest, messages as M, persist
from relaymill.plans import flows
from relaymill.schema import QUEUES, REQUEST, ROUTES
from relaymill.sources import files, queues
from relaymill.sources.bucketed import BucketedTable
from relaymill.sources.requests import read_requests, stream_requests
from relaymill.streaming import flow as streaming


def clock():
    return F.col("clock")


def body(i, **keys):
    base = {"flow": 1, "message_id": f"m{i % 7}", "item_id": i, "counter": i, "history": []}
    return json.dumps(base | keys)


def cells(rows):
    shown = rows.drop("raw_payload").orderBy("message_id").collect()
    return [r.asDict(recursive=True) for r in shown]


def expected(records):
    return cells(persist.upsert(M.accepted(flows.finish_records(records, ROUTES[1][0], clock()))))


def test_unknown_queue():
    with pytest.raises(ValueError):
        queues.queue_path("/tmp", "nope")


@pytest.mark.parametrize("format", ["parquet", "json"])
def test_queue_folders(as_records, spark, tmp_path, format):
    records = as_records([body(1), body(2)])
    queues.publish(records, str(tmp_path), QUEUES[0], format)
    queues.publish(records, str(tmp_path), QUEUES[0], format)
    waiting = queues.consume(spark, str(tmp_path), QUEUES[0], format)
    assert sorted(r.body for r in waiting.collect()) == sorted([body(1), body(2)] * 2)
    assert waiting.schema["clock"].dataType.typeName() == "timestamp"
    assert {r.clock for r in waiting.collect()} == {r.clock for r in records.collect()}


def test_handlers_resume_where_they_stopped(as_records, spark, tmp_path):
    root = str(tmp_path)
    bodies = [body(i) for i in range(40)] + [body(99, counter=None), "{", body(98, item_id=None)]
    records = as_records(bodies)
    early, late = records.where("seq <= 25"), records.where("seq > 25")

    def publish(part):
        queues.publish(part.repartition(2, "seq"), root, ROUTES[1][0])

    for route in ROUTES.values():  # every queue exists before its consumer starts
        queues.publish(records.where("false"), root, route[0])
    publish(early)
    table = streaming.drain(spark, root, clock(), max_files=1)
    assert cells(table.current()) == expected(early)
    table.compact()
    publish(late)
    table = streaming.drain(spark, root, clock(), max_files=2)
    assert cells(table.current()) == expected(records)
    table.compact()
    assert cells(table.scan()) == expected(records)
    dead = queues.dead_letters(spark, root, ROUTES[1][1])
    assert sorted((r.stage, r.reason) for r in dead.collect()) == [
        (2, "counter_not_a_number"), (2, "not_json"),
    ]
    assert [(r.stage, r.reason) for r in table.rejected().collect()] == [(4, "item_id_missing")]


def test_delivered_twice_is_stored_once(as_records, spark, tmp_path):
    root = str(tmp_path)
    records = as_records([body(i) for i in range(20)])
    queues.publish(records.where("false"), root, ROUTES[2][0])
    for part in (records, records, records.where("seq % 2 = 0")):
        queues.publish(part.repartition(2, "seq"), root, ROUTES[1][0])
    table = streaming.drain(spark, root, clock())
    assert cells(table.current()) == expected(records)


def test_requests_stream_into_the_first_queues(as_requests, spark, tmp_path):
    rows = [("/api/flow1", None), ("/api/flow2", '{"value": 31}'), ("/api/batch", '{"count": 2}'),
            ("/x", None), ("/api/flow1", "{bad")]
    requests = as_requests(rows)
    requests.write.parquet(f"{tmp_path}/requests")
    assert read_requests(spark, f"{tmp_path}/requests").schema == REQUEST
    stream = stream_requests(spark, f"{tmp_path}/requests", max_files=1)
    streaming.start_ingest(stream, str(tmp_path)).awaitTermination()
    for flow in ROUTES:
        got = queues.consume(spark, str(tmp_path), ROUTES[flow][0]).select("seq", "position", "body")
        made = M.encode(ingest.ingest(requests).where(F.col("flow") == flow)).select("seq", "position", "body")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, made.collect()))
        assert got.count() == 3
    table = streaming.drain(spark, str(tmp_path), clock())
    whole = persist.upsert(M.accepted(flows.finish(ingest.ingest(requests), None, clock())))
    assert cells(table.current()) == cells(whole) and table.current().count() == 6


def test_running_handlers_can_be_stopped(as_records, spark, tmp_path):
    root = str(tmp_path)
    records = as_records([body(i) for i in range(10)])
    for queue in QUEUES:  # every queue exists before its consumer starts
        queues.publish(records.where("false"), root, queue)
    running = streaming.start_all(spark, root, clock())
    try:
        assert len(running) == 6 and all(q.isActive for q in running)
        queues.publish(records, root, ROUTES[1][0])
        for _ in range(3):
            for query in running:
                query.processAllAvailable()
    finally:
        for query in running:
            query.stop()
    assert cells(streaming.ProcessedTable(spark, root).current()) == expected(records)


def test_requests_run_through_all_handlers(as_requests, spark, tmp_path):
    """Seven queries from requests to the table; no queue is there before."""
    root = str(tmp_path)
    requests = as_requests([("/api/flow1", None), ("/api/flow2", '{"value": 31}'), ("/api/batch", '{"count": 2}')])
    requests.write.parquet(f"{root}/requests")
    running = streaming.start_all(spark, root, clock(), requests=stream_requests(spark, f"{root}/requests"))
    try:
        assert len(running) == 7
        for _ in range(4):
            for query in running:
                query.processAllAvailable()
    finally:
        for query in running:
            query.stop()
    whole = persist.upsert(M.accepted(flows.finish(ingest.ingest(requests), None, clock())))
    assert cells(streaming.ProcessedTable(spark, root).current()) == cells(whole)


def test_micro_batches_are_bounded_by_bytes(as_records, spark, tmp_path):
    root, queue = str(tmp_path), ROUTES[1][0]
    queues.publish(as_records([body(i) for i in range(30)]).repartition(6, "seq"), root, queue)
    with pytest.raises(ValueError):
        queues.stream_queue(spark, root, queue, max_files=1, max_bytes=1)
    query = streaming.start_hop(spark, root, queue, clock(), max_bytes=1)
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p.numInputRows]) == 6  # one file is always taken
    assert queues.consume(spark, root, ROUTES[1][1]).count() == 30


def test_into_a_bucketed_table(as_records, spark, tmp_path):
    root = str(tmp_path)
    records = as_records([body(i) for i in range(40)] + [body(1, item_id=None)])
    for route in ROUTES.values():
        queues.publish(records.where("false"), root, route[0])
    queues.publish(records.repartition(5, "seq"), root, ROUTES[1][0])
    table = BucketedTable(spark, f"rm_stream_{tmp_path.name}.processed", f"{root}/table", buckets=4)
    log = streaming.drain(spark, root, clock(), max_files=2, into=table)
    assert cells(table.scan()) == expected(records)
    assert log.deliveries().count() == 0 and [r.reason for r in log.rejected().collect()] == ["item_id_missing"]


def test_rows_for_a_topic(as_records):
    records = as_records([body(1), body(9)]).withColumns(
        {"reject_stage": F.lit(None).cast("int"), "reject_reason": F.when(F.col("seq") == 2, "x")}
    )
    assert [tuple(r) for r in queues.to_topic(records).collect()] == [("m1", body(1))]


def test_competing_consumers_share_a_queue(as_records, spark, tmp_path):
    """Each file goes to one of them; one that was stopped takes up its part later."""
    root, queue = str(tmp_path), ROUTES[1][2]
    records = as_records([body(i) for i in range(60)])

    def work(*numbers):
        for k in numbers:
            streaming.start_persist(spark, root, queue, clock(), share=(k, 3)).awaitTermination()

    queues.publish(records.where("seq <= 30").repartition(24, "seq"), root, queue)
    work(0, 1, 2)
    queues.publish(records.where("seq > 30").repartition(24, "seq"), root, queue)
    work(2, 0)
    table = streaming.ProcessedTable(spark, root)
    partly = table.deliveries().count()
    assert 30 <= partly < 60
    work(1)
    work(1, 2)  # nothing is left
    assert table.deliveries().count() == 60 == table.deliveries().select("seq").distinct().count()
    taken = table.deliveries().groupBy("source").count().collect()
    assert len(taken) == 3 and all(r["count"] > 0 for r in taken)
    assert cells(table.current()) == cells(persist.upsert(M.accepted(flows.finish_records(records, queue, clock()))))


def test_many_micro_batches_leave_few_folders(as_records, spark, tmp_path, monkeypatch):
    """What a merge covers goes with the next one, and merges wait until there is enough."""
    monkeypatch.setattr(streaming, "MERGED_AFTER", 4)
    root = str(tmp_path)
    rows = M.accepted(
        flows.finish_records(as_records([body(i, message_id=f"m{i}") for i in range(40)]), ROUTES[1][0], clock())
    ).drop("body", "reject_stage", "reject_reason")
    for low in range(0, 40, 2):
        rows.where((F.col("seq") > low) & (F.col("seq") <= low + 2)).coalesce(1).write.mode("append").parquet(f"{root}/in")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    streaming.start_upsert(source, root).awaitTermination()
    folder = f"{root}/changes/upsert"
    merged = files.partition_values(spark, folder, "upto")
    left = files.partition_values(spark, folder, "batch_id")
    assert 1 <= len(merged) <= 2 and len(left) <= 12
    assert cells(streaming.upserted(spark, root)) == cells(persist.upsert(rows))


def test_stateful_upsert_under_a_collation(as_records, spark, tmp_path):
    root = str(tmp_path)
    bodies = [body(1, message_id="Ab"), body(2, message_id="AB "), body(3, message_id="b")]
    rows = M.accepted(flows.finish_records(as_records(bodies), ROUTES[1][0], clock())).drop(
        "body", "reject_stage", "reject_reason"
    )
    for seq in (1, 2, 3):
        rows.where(F.col("seq") == seq).write.mode("append").parquet(f"{root}/in")
        source = spark.readStream.schema(rows.schema).parquet(f"{root}/in")
        streaming.start_upsert(source, root, collation="UNICODE_CI_RTRIM").awaitTermination()
    assert cells(streaming.upserted(spark, root)) == cells(persist.upsert(rows, "UNICODE_CI_RTRIM"))
    assert streaming.upserted(spark, root).count() == 2


def test_stateful_upsert(as_records, spark, tmp_path):
    root = str(tmp_path)
    records = as_records([body(i) for i in range(30)])
    rows = M.accepted(flows.finish_records(records, ROUTES[1][0], clock())).drop(
        "body", "reject_stage", "reject_reason"
    )
    schema = rows.schema
    for low, high in ((0, 15), (15, 40)):  # stop and resume in between
        rows.where((F.col("seq") > low) & (F.col("seq") <= high)).repartition(2, "seq").write.mode(
            "append"
        ).parquet(f"{root}/in")
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
        streaming.start_upsert(source, root).awaitTermination()
    assert cells(streaming.upserted(spark, root)) == expected(records)
