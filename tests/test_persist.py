"""Table rows, constraints, upsert and the delivery log."""

import datetime as dt
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from relaymill.operators import messages as M, persist
from relaymill.plans import flows
from relaymill.schema import PROCESSED, ROUTES
from relaymill.sources import files
from relaymill.sources.table import ProcessedTable, create_table, declared_columns, merge_into
from tests.conftest import T0

LAST = ROUTES[1][2]


def clock():
    return F.col("clock")


def doc(**keys):
    base = {"message_id": "m", "flow": 1, "item_id": 1, "history": []}
    return json.dumps({k: v for k, v in (base | keys).items() if v is not Ellipsis})


def stored(as_records, *bodies):
    return flows.finish_records(as_records(list(bodies)), LAST, clock()).orderBy("seq").collect()


REFUSED = [
    ({"message_id": ...}, "message_id_missing"),
    ({"message_id": None}, "message_id_missing"),
    ({"message_id": {"a": 1}}, "message_id_unusable"),
    ({"message_id": "x" * 65}, "message_id_too_long"),
    ({"flow": ...}, "flow_missing"),
    ({"flow": "one"}, "flow_unusable"),
    ({"flow": 2**31}, "flow_out_of_range"),
    ({"item_id": None}, "item_id_missing"),
    ({"item_id": [1]}, "item_id_unusable"),
    ({"item_id": -(2**31) - 1}, "item_id_out_of_range"),
    ({"item_id": 10**25}, "item_id_unusable"),
    ({"initial_data": "x" * 256}, "initial_data_too_long"),
    ({"initial_data": ["x"]}, "initial_data_unusable"),
    ({"counter": 2**31}, "counter_out_of_range"),
    ({"counter": "many"}, "counter_unusable"),
    ({"value": 1e8}, "value_unusable"),
    ({"value": -99999999.995}, "value_unusable"),
    ({"value": 1e400}, "value_unusable"),
    ({"value": "x"}, "value_unusable"),
    ({"examined_status": "x" * 51}, "examined_status_too_long"),
    ({"verified_by": {}}, "verified_by_unusable"),
    ({"verified_by": "x" * 51}, "verified_by_too_long"),
    ({"message_id": ..., "flow": ...}, "message_id_missing"),
]


def test_refused(as_records):
    bodies = [doc(**keys).replace("Infinity", "1e400") for keys, _ in REFUSED]
    rows = stored(as_records, *bodies)
    assert [(r.reject_stage, r.reject_reason) for r in rows] == [(4, why) for _, why in REFUSED]


STORED = [
    ({"message_id": "x" * 64}, "message_id", "x" * 64),
    ({"message_id": ""}, "message_id", ""),
    ({"message_id": 5}, "message_id", "5"),
    ({"flow": True}, "flow_id", 1),
    ({"flow": 7}, "flow_id", 7),
    ({"item_id": 2**31 - 1}, "item_id", 2**31 - 1),
    ({"item_id": "12"}, "item_id", 12),
    ({"item_id": 1.5}, "item_id", 2),
    ({"initial_data": "é" * 255}, "initial_data", "é" * 255),
    ({"initial_data": 7}, "initial_data", "7"),
    ({"initial_data": True}, "initial_data", "1"),
    ({"initial_data": None}, "initial_data", None),
    ({}, "initial_data", None),
    ({"counter": 2.5}, "counter_value", 3),
    ({"counter": -2.5}, "counter_value", -3),
    ({"counter": None}, "counter_value", None),
    ({"value": 40.25}, "metric_value", Decimal("40.25")),
    ({"value": 1.005}, "metric_value", Decimal("1.01")),
    ({"value": "12.5"}, "metric_value", Decimal("12.50")),
    ({"value": 99999999.99}, "metric_value", Decimal("99999999.99")),
    ({"examined_status": "x" * 50}, "examined_status", "x" * 50),
]


def test_stored(as_records):
    rows = stored(as_records, *[doc(**keys) for keys, _, _ in STORED])
    assert {r.reject_reason for r in rows} == {None}
    assert [r[c] for r, (_, c, _) in zip(rows, STORED)] == [v for _, _, v in STORED]


def test_documented_run_flow1_and_flow2(as_requests):
    from relaymill.operators import ingest, inspect

    rows = [("/api/flow1", '{"item_id":101,"counter":500,"initial_data":"E2E 1"}'),
            ("/api/flow2", '{"item_id":202,"value":35.00,"initial_data":"E2E 2"}')]
    made = ingest.direct_messages(as_requests(rows))
    table = persist.upsert(M.accepted(flows.finish(made, None, clock())))
    b, a = inspect.latest(table).collect()
    assert tuple(a)[1:-1] == (1, 101, 510, None, None, None)
    assert tuple(b)[1:-1] == (2, 202, None, Decimal("40.25"), "HIGH", "process3")
    t = "2025-08-20 10:15:20"
    detail = inspect.latest_of_flow(table, 1).first()
    assert json.loads(detail.audit_trail) == [
        {"stage": "process1_created", "timestamp": t, "status": "prepared", "source": "rest_api"},
        {"stage": "process2_reflected", "timestamp": t,
         "modification": "Added +10 to counter and flagged reflected"},
        {"stage": "process3_received_and_forwarded", "timestamp": t, "status": "forwarded_to_process4"},
        {"stage": "process4_saved_to_mariadb", "timestamp": t,
         "database_action": "INSERT/UPDATE processed_messages"},
    ]
    detail = inspect.latest_of_flow(table, 2).first()
    assert json.loads(detail.audit_trail)[1:] == [
        {"stage": "process2_examined_and_forwarded", "timestamp": t, "status_assigned": "HIGH",
         "modification": "Applied 15% scaling factor and assigned status"},
        {"stage": "process3_reflected", "timestamp": t,
         "modification": "Added verification seal and marked completed"},
        {"stage": "process4_saved_to_mariadb", "timestamp": t,
         "database_action": "INSERT/UPDATE processed_messages"},
    ]
    payloads = {r.flow_id: json.loads(r.raw_payload) for r in table.collect()}
    assert payloads[1]["process2_flow1_reflected"] and payloads[1]["process3_acknowledged"]
    assert payloads[2]["completed"] is True and payloads[2]["value"] == 40.25
    assert len(payloads[1]["history"]) == len(payloads[2]["history"]) == 4


def test_text_kept_untyped_reaches_the_document_as_it_is(as_requests):
    from relaymill.operators import ingest

    rows = [("/api/flow1", '{"item_id": 1, "initial_data": 7}'),
            ("/api/flow1", '{"item_id": 1, "initial_data": [7]}')]
    done = flows.finish(ingest.direct_messages(as_requests(rows)), None, clock()).orderBy("seq")
    a, b = done.collect()
    assert (a.initial_data, json.loads(a.raw_payload)["initial_data"]) == ("7", 7)
    assert b.reject_reason == "initial_data_unusable"


def test_hops_through_queues_equal_one_pass(as_records):
    bodies = [doc(counter=c, tag=c, history=[{"x": 1}]) for c in (1, 2.5, True, 2**40)]
    hop = as_records(bodies)
    for queue in ROUTES[1][:2]:
        hop = flows.forward(hop, queue, clock()).select("seq", "position", "clock", "body")
    slow = flows.finish_records(hop, LAST, clock()).drop("body").orderBy("seq").collect()
    fast = flows.finish_records(as_records(bodies), ROUTES[1][0], clock()).drop("body").orderBy("seq").collect()
    for s, f in zip(slow, fast, strict=True):
        assert json.loads(s.raw_payload) == json.loads(f.raw_payload)
        assert s.asDict() | {"raw_payload": 0} == f.asDict() | {"raw_payload": 0}


def test_numbers_that_are_not_finite_take_the_same_way_on_both_paths(spark, as_requests, tmp_path):
    from relaymill.operators import ingest

    rows = [("/api/flow2", '{"item_id": 1, "value": "nan"}'), ("/api/flow2", '{"item_id": 2, "value": "-inf"}'),
            ("/api/flow2", '{"item_id": 3, "value": 1e400}'), ("/api/flow2", '{"item_id": 4, "value": 5}')]
    made = ingest.direct_messages(as_requests(rows))
    fast = flows.finish(made, None, clock()).orderBy("seq").collect()
    hop = M.encode(made).select("seq", "position", "clock", "body")
    for queue in ROUTES[2][:2]:  # by way of files, as between queues
        hop.write.parquet(f"{tmp_path}/{queue}")
        hop = flows.forward(spark.read.parquet(f"{tmp_path}/{queue}"), queue, clock())
        assert hop.where("reject_reason is not null").count() == 0
        hop = hop.select("seq", "position", "clock", "body")
    hop.write.parquet(f"{tmp_path}/last")
    hop = spark.read.parquet(f"{tmp_path}/last")
    slow = flows.finish_records(hop, ROUTES[2][2], clock()).orderBy("seq").collect()
    expected = [(4, "value_unusable")] * 3 + [(None, None)]
    assert [(r.reject_stage, r.reject_reason) for r in fast] == expected
    assert [(r.reject_stage, r.reject_reason) for r in slow] == expected
    assert [r.examined_status for r in slow] == [r.examined_status for r in fast] == ["NORMAL", "NORMAL", "HIGH", "NORMAL"]


def test_number_text_is_decimal_only(as_records):
    texts = ["12d", "12f", "0x1p3", "NaN", "1_0", "", " 7 ", "+8", "9.", ".5e1", "1e2"]
    rows = stored(as_records, *[doc(item_id=t) for t in texts])
    assert [r.item_id for r in rows] == [None] * 6 + [7, 8, 9, 5, 100]
    assert [r.reject_reason for r in rows] == ["item_id_unusable"] * 6 + [None] * 5


# --- upsert -----------------------------------------------------------------------------


def deliveries(spark, rows):
    """rows: (seq, message_id, item_id, counter_value, metric_value)"""
    data = [
        (seq, key, 1, item, f"text {seq}", counter, None if metric is None else Decimal(metric),
         None, f"by {seq}", [], "{}", T0 + dt.timedelta(seconds=seq % 1000))
        for seq, key, item, counter, metric in rows
    ]
    names = "seq bigint, message_id string, flow_id int, item_id int, initial_data string, " \
        "counter_value int, metric_value decimal(10,2), examined_status string, " \
        "verified_by string, history_trail array<struct<stage:string,timestamp:string," \
        "status:string,source:string,status_assigned:string,modification:string," \
        "database_action:string,other:string>>, raw_payload string, created_at timestamp"
    return spark.createDataFrame(data, names)


LOG = [(1, "a", 10, 1, "1.00"), (2, "b", 20, 2, None), (3, "a", 11, None, None), (4, "b", 21, 5, "2.50"),
       (5, "c", 30, None, "3.00"), (6, "a", 12, 7, None)]
EXPECTED = [
    (1, "a", 10, "text 1", 7, None, "by 6"),
    (2, "b", 20, "text 2", 5, Decimal("2.50"), "by 4"),
    (5, "c", 30, "text 5", None, Decimal("3.00"), "by 5"),
]


def shown(rows):
    columns = ("id", "message_id", "item_id", "initial_data", "counter_value", "metric_value", "verified_by")
    return [tuple(r) for r in rows.select(*columns).orderBy("id").collect()]


def test_first_keeps_last_overwrites(spark):
    table = persist.upsert(deliveries(spark, LOG))
    assert table.columns == PROCESSED.names
    assert shown(table) == EXPECTED


def test_null_overwrites(spark):
    assert shown(persist.upsert(deliveries(spark, LOG[:3])))[0][4:6] == (None, None)


def test_order_partitions_and_duplicates_do_not_matter(spark):
    rows = deliveries(spark, LOG)
    shuffled = rows.union(rows).union(rows).repartition(7).orderBy(F.rand(3))
    assert shown(persist.upsert(shuffled)) == EXPECTED


def test_states_merge_in_any_split(spark):
    for cut in range(1, len(LOG)):
        parts = [persist.upsert_state(deliveries(spark, part)) for part in (LOG[cut:], LOG[:cut])]
        merged = persist.merge_states(parts[0].unionByName(parts[1]))
        assert shown(persist.table_rows(merged)) == EXPECTED


def test_collated_keys(spark):
    rows = deliveries(spark, [(1, "Ab ", 1, 1, None), (2, "aB", 2, 2, None)])
    assert persist.upsert(rows).count() == 2
    one = persist.upsert(rows, collation="UNICODE_CI_RTRIM").collect()
    assert [(r.id, r.message_id, r.counter_value) for r in one] == [(1, "Ab ", 2)]


def test_the_later_arrival_of_the_same_place_wins(spark, log):
    early, late = (deliveries(spark, [(5, "a", item, item, None)]) for item in (11, 12))
    none = {"reject_stage": F.lit(None).cast("int"), "reject_reason": F.lit(None).cast("string")}
    log.deliver(early.withColumns(none), "q1", 0)
    log.deliver(late.withColumns(none), "q1", 1)
    for again in range(2):
        assert [(r.item_id, r.counter_value) for r in log.current().collect()] == [(11, 12)]
        log.compact()
    assert [(r.item_id, r.counter_value) for r in log.scan().collect()] == [(11, 12)]
    one = [tuple(r) for r in persist.upsert(early.union(late)).collect()]
    assert one == [tuple(r) for r in persist.upsert(late.union(early).repartition(3)).collect()]


def test_many_batches_are_listed_once(spark, log, monkeypatch):
    from pathlib import Path

    from relaymill.sources import files

    put(log, spark, LOG[:2], "q1", 0)
    for batch in range(1, 500):
        folder = Path(f"{log.root}/deliveries/source=q1/batch_id={batch}")
        folder.mkdir()
        (folder / "_SUCCESS").touch()
    calls = []
    opened = files._open
    monkeypatch.setattr(files, "_open", lambda spark, path: calls.append(path) or opened(spark, path))
    assert log._complete_batches() == {"q1": 499}
    assert len(calls) < 10


def test_collated_table_and_retired_versions(spark, tmp_path):
    log = ProcessedTable(spark, str(tmp_path / "t"), collation="UNICODE_CI_RTRIM")
    put(log, spark, [(1, "Ab ", 1, 1, None)], "q1", 0)
    log.compact()
    put(log, spark, [(2, "aB", 2, 2, None), (3, "c", 3, 3, None)], "q1", 1)
    expected = [(1, 1, 2), (3, 3, 3)]
    for rows in (log.current(), log.compact() and log.scan()):
        assert sorted((r.id, r.item_id, r.counter_value) for r in rows.collect()) == expected
    log.compact()
    log.retire(versions=1)
    assert sorted((r.id, r.item_id, r.counter_value) for r in log.current().collect()) == expected
    put(log, spark, [(4, "C", 4, 4, None)], "q1", 2)
    assert sorted((r.id, r.item_id, r.counter_value) for r in log.current().collect()) == [(1, 1, 2), (3, 3, 4)]


def test_no_mark_of_completion_is_an_error(spark, log):
    import os

    put(log, spark, LOG[:2], "q1", 0)
    os.unlink(f"{log.root}/deliveries/source=q1/batch_id=0/_SUCCESS")
    with pytest.raises(ValueError, match="_SUCCESS"):
        log.current()


def test_one_hot_key(spark):
    hot = spark.range(20_000).select(
        F.col("id").alias("seq"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("message_id"),
        F.col("id").cast("int").alias("item_id"),
        F.col("id").cast("int").alias("counter_value"),
    )
    table = persist.upsert(hot)
    assert table.count() == 20_000 - 6667 + 1
    (r,) = table.where("message_id = 'hot'").collect()
    assert (r.id, r.item_id, r.counter_value) == (0, 0, 19_998)


# --- delivery log and snapshots -----------------------------------------------------------


@pytest.fixture
def log(spark, tmp_path):
    return ProcessedTable(spark, str(tmp_path / "table"))


def put(log, spark, rows, source, batch):
    accepted = deliveries(spark, rows).withColumns(
        {"reject_stage": F.lit(None).cast("int"), "reject_reason": F.lit(None).cast("string")}
    )
    log.deliver(accepted, source, batch)


def test_log_and_snapshots(spark, log):
    put(log, spark, LOG[:2], "q1", 0)
    put(log, spark, LOG[2:4], "q1", 1)
    assert log.version() == 0
    assert shown(log.current()) == shown(persist.upsert(deliveries(spark, LOG[:4])))
    assert log.compact() == 1
    assert shown(log.scan()) == shown(persist.upsert(deliveries(spark, LOG[:4])))
    put(log, spark, LOG[4:], "q2", 0)
    assert shown(log.scan()) == shown(persist.upsert(deliveries(spark, LOG[:4])))
    assert shown(log.current()) == EXPECTED
    assert log.compact() == 2
    assert shown(log.scan()) == shown(log.current()) == EXPECTED


def test_batch_run_again_changes_nothing(spark, log):
    put(log, spark, LOG[:4], "q1", 0)
    log.compact()
    put(log, spark, LOG[:4], "q1", 0)  # same batch once more
    put(log, spark, LOG[2:4], "q1", 1)  # the same deliveries under a new number
    put(log, spark, LOG[4:], "q1", 2)
    assert shown(log.current()) == EXPECTED
    log.compact()
    assert shown(log.scan()) == EXPECTED


def test_unfinished_writes_are_not_read(spark, log):
    put(log, spark, LOG[:4], "q1", 0)
    log.compact()
    put(log, spark, LOG[4:], "q1", 1)
    put(log, spark, [(9, "z", 1, 1, None)], "q1", 2)
    import os

    os.unlink(f"{log.root}/deliveries/source=q1/batch_id=1/_SUCCESS")
    assert shown(log.current()) == shown(persist.upsert(deliveries(spark, LOG[:4])))
    log.compact()
    os.unlink(f"{log.root}/snapshots/version=2/rows/_SUCCESS")
    assert log.version() == 1
    put(log, spark, LOG[4:], "q1", 1)
    assert len(shown(log.current())) == 4


def test_refused_rows_never_touch_the_table(spark, as_records, log):
    good = doc(counter=1)
    bad = doc(counter=2**40)
    log.deliver(flows.finish_records(as_records([good, bad]), LAST, clock()), LAST, 0)
    assert [r.counter_value for r in log.current().collect()] == [1]
    (lost,) = log.rejected().collect()
    assert (lost.seq, lost.stage, lost.reason, lost.body) == (2, 4, "counter_out_of_range", bad)


def test_layout_serves_item_and_time_alike(spark, tmp_path, monkeypatch):
    """Of more than 100 files a lookup by item and one by time may concern a few only."""
    import pyarrow.parquet as pq

    n = 60_000
    rows = spark.range(n).select(
        F.col("id").alias("seq"), F.concat(F.lit("m"), "id").alias("message_id"),
        (F.col("id") % 2 + 1).cast("int").alias("flow_id"),
        (F.xxhash64("id") % 5000 + 5000).cast("int").alias("item_id"), F.lit("x").alias("initial_data"),
        *[F.lit(None).cast(PROCESSED[c].dataType).alias(c) for c in ("counter_value", "metric_value", "examined_status", "verified_by")],
        F.array().cast(PROCESSED["history_trail"].dataType).alias("history_trail"), F.lit("{}").alias("raw_payload"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 7).alias("created_at"),
    )
    table = ProcessedTable(spark, str(tmp_path))
    table.deliver(rows, "q", 0)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "128")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table.compact()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    spans = []
    for path in (tmp_path / "snapshots" / "version=1" / "rows").glob("*.parquet"):
        meta = pq.ParquetFile(path).metadata
        names = [meta.schema.column(i).name for i in range(meta.num_columns)]
        found = {}
        for name in ("flow_id", "item_id", "created_at"):
            stats = [meta.row_group(g).column(names.index(name)).statistics for g in range(meta.num_row_groups)]
            found[name] = (min(s.min for s in stats), max(s.max for s in stats))
        spans.append(found)
    assert len(spans) >= 100

    def concerned(**wanted):
        return sum(all(s[c][0] <= v <= s[c][1] for c, v in wanted.items()) for s in spans)

    one = rows.where("seq = 31000").first()
    by_item = concerned(flow_id=one.flow_id, item_id=one.item_id)
    by_time = concerned(created_at=spans[0]["created_at"][0].fromtimestamp(one.created_at.timestamp(), spans[0]["created_at"][0].tzinfo))
    assert 1 <= by_item <= 24 and 1 <= by_time <= 40
    got = table.scan().where((F.col("flow_id") == one.flow_id) & (F.col("item_id") == one.item_id))
    assert one.message_id in {r.message_id for r in got.collect()} and table.scan().count() == n


def test_retired_batches_leave_no_folders(spark, as_records, log):
    bodies = [doc(message_id=f"m{i}") for i in range(4)] + [doc(item_id=None)]
    for batch in range(6):
        log.deliver(flows.finish_records(as_records(bodies), LAST, clock()), "q", batch)
        if batch % 2:
            log.compact()
            log.retire(versions=1)
            assert files.children(spark, f"{log.root}/deliveries/source=q") == []
            assert log.scan().count() == 4 and log.rejected().count() == batch + 1
    assert log._complete_batches() == {} and log.version() == 3 and log.current().count() == 4
    assert files.partition_values(spark, f"{log.root}/snapshots", "version") == ["3"]


def test_snapshots_wait_until_they_are_due(spark, log):
    cells = [(i, f"m{i}", i, i, None) for i in range(1, 41)]
    log.deliver(deliveries(spark, cells), "q", 0)
    assert log.compact_if_due() and not log.compact_if_due()
    log.deliver(deliveries(spark, [(100, "m1", 1, 7, None), (101, "n", 1, 8, None)]), "q", 1)
    assert not log.compact_if_due() and log.version() == 1 and log.current().count() == 41
    log.deliver(deliveries(spark, [(200 + i, f"k{i}", 1, 8, None) for i in range(12)]), "q", 2)
    assert log.compact_if_due() and log.version() == 2 and log.scan().count() == 53


def test_a_published_table_is_never_missing(spark, log, monkeypatch):
    log.deliver(deliveries(spark, LOG), "q", 0)
    log.compact()
    log.publish_as("rm_swap.processed_messages")
    first = spark.table("rm_swap.processed_messages").count()
    seen, run = [], spark.sql

    def watched(text, *args, **kwargs):
        out = run(text, *args, **kwargs)
        seen.append(spark.catalog.tableExists("rm_swap.processed_messages"))
        return out

    log.deliver(deliveries(spark, [(9000, "brand-new", 1, 2, None)]), "q", 1)
    log.compact()
    monkeypatch.setattr(spark, "sql", watched)
    log.publish_as("rm_swap.processed_messages")
    assert seen and all(seen)
    assert spark.table("rm_swap.processed_messages").count() == first + 1
    spark.catalog.refreshTable("rm_swap.processed_messages")


def test_table_declaration(spark, tmp_path):
    create_table(spark, "rm_test.processed_messages", str(tmp_path / "t"))
    create_table(spark, "rm_test.processed_messages", str(tmp_path / "t"))
    table = spark.table("rm_test.processed_messages")
    assert [(f.name, f.dataType) for f in table.schema] == [(f.name, f.dataType) for f in PROCESSED]
    assert declared_columns().count("NOT NULL") == sum(not f.nullable for f in PROCESSED)
    log = ProcessedTable(spark, str(tmp_path / "log"))
    put(log, spark, LOG, "q1", 0)
    log.compact()
    log.publish_as("rm_test.processed_messages")
    assert shown(spark.table("rm_test.processed_messages")) == EXPECTED
    with pytest.raises(Exception, match="MERGE"):  # parquet cannot; formats that can, will
        merge_into(spark, deliveries(spark, LOG), "rm_test.processed_messages")
    spark.sql("DROP DATABASE rm_test CASCADE")
