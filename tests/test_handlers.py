"""What a handler does for every document, and must not do twice or carry along."""

import json

from pyspark.sql import functions as F

from relaymill.functions import audit, json_values as J
from relaymill.operators import messages as M
from relaymill.plans import flows
from relaymill.schema import FLOW1_P1_TO_P2, FLOW1_P2_TO_P3
from relaymill.sources import queues
from relaymill.sources.requests import stream_requests
from relaymill.streaming import flow as streaming

ENTRY = '{"stage":"a","timestamp":"2025-01-01 00:00:00"}'
HISTORIES = [
    f"[{ENTRY}]", f"[{ENTRY},{ENTRY}]", f"[{ENTRY} , {ENTRY}]", f" [{ENTRY}]", "[]", "[{}]", "[1]", '[{"stage":1}]', "null", "{}",
    '[{"stage":"é漢\u2028\x7f/]}"}]', '[{"stage":"😀"}]', r'[{"stage":"a\"b"}]', r'[{"stage":"\u0061"}]', '[{"stage":"a","stage":"b"}]', '["x"]', '[{"a":{"b":"c"}}]',
    f"[{ENTRY},{{}}]", f"[{ENTRY},[]]", '[{"":""}]', "[" + ",".join([ENTRY] * 20_000) + "]",
]
BODIES = (
    [f'{{"message_id":"m","history":{h},"item_id":1}}' for h in HISTORIES]
    + [f'{{"a":{{"history":[{ENTRY}]}}}}', f'{{"a":"history","history":[{ENTRY}]}}', f'{{"history":[{ENTRY}],"history":[{ENTRY},{ENTRY}]}}']
    + [r'{"a":"\"history\":[{\"x\":\"y\"}]","item_id":2}', f'[{{"history":[{ENTRY}]}}]', "{}", "1", "", None, "{bad", '{"a":1},{"b":2}', ' {"item_id":3} ']
)


def test_trails_and_keys_are_as_spark_reads_them_from_the_text(as_records):
    rows = M.decode(as_records(BODIES), 3).select("seq", "body", "past", "keys", "reject_reason")
    rows = rows.withColumns(
        {
            "wanted": F.get_json_object("body", "$.history"), "wanted_keys": F.array_sort(F.array_distinct(F.json_object_keys("body"))),
            "sorted": F.array_sort("keys"),
        }
    ).collect()
    assert len(rows) == len(BODIES)
    read = [r for r in rows if r.reject_reason is None]
    assert len(read) > 20
    for r in read:
        assert r.sorted == r.wanted_keys, r.body
        last = dict(json.loads(r.body, object_pairs_hook=list)).get("history")
        if not isinstance(last, list) or r.wanted is None or not r.wanted.startswith("["):
            assert r.past is None, r.body
        elif r.body.count('"history"') == 1 and "\\u" not in r.body:
            assert r.past == r.wanted, r.body
        else:
            assert json.loads(r.past) == json.loads(r.body)["history"], r.body


def test_a_trail_as_written_is_found_without_parsing(spark):
    rows = spark.createDataFrame([(b,) for b in BODIES], "body string")
    found = {r.body: r.found for r in rows.select("body", audit.as_written(F.col("body")).alias("found")).collect()}
    for history in (HISTORIES[0], HISTORIES[1], HISTORIES[14], HISTORIES[-1]):
        assert found[f'{{"message_id":"m","history":{history},"item_id":1}}'] == history
    for history in (HISTORIES[2], HISTORIES[5], r'[{"stage":"a\"b"}]'):
        assert not found[f'{{"message_id":"m","history":{history},"item_id":1}}']


def test_documents_without_other_keys_are_not_carried_along(as_records):
    bodies = ['{"message_id":"m","counter":null,"history":[]}', '{"message_id":"m","tag":1}', "{}", "{bad", "[1]"]
    rows = M.decode(as_records(bodies), 2).select("seq", F.col("verbatim").isNotNull().alias("carried")).orderBy("seq").collect()
    assert [r.carried for r in rows] == [False, True, False, False, False]


def test_bytes_are_cut_at_the_ends(spark):
    rows = spark.createDataFrame([('{"é":"漢😀"}',), ("{}",), (None,)], "t string")
    got = rows.select(J.object_body(F.col("t")).alias("a"), J.cut_bytes(F.col("t"), last=1).alias("b")).collect()
    assert [tuple(r) for r in got] == [('"é":"漢😀"', '{"é":"漢😀"'), (None, "{"), (None, None)]


def test_records_are_not_sorted_to_be_written_by_outcome(spark, as_records, tmp_path):
    """Refused and accepted records in one task, in the order in which they came."""
    bodies = [("{bad" if i % 3 == 0 else f'{{"item_id":{i},"history":[]}}') for i in range(30)]
    out = flows.forward(as_records(bodies).coalesce(1), FLOW1_P2_TO_P3)
    queues.publish(out, str(tmp_path), FLOW1_P2_TO_P3)
    assert queues.consume(spark, str(tmp_path), FLOW1_P2_TO_P3).count() == 20
    assert queues.dead_letters(spark, str(tmp_path), FLOW1_P2_TO_P3).count() == 10
    assert int(spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")) >= 2


def test_ingest_holds_finished_records(spark, as_requests, tmp_path, monkeypatch):
    held = []
    persist = type(spark.range(1)).persist
    monkeypatch.setattr(type(spark.range(1)), "persist", lambda self, *a: held.append(self.columns) or persist(self, *a))
    as_requests([("/api/flow1", '{"counter": 1}'), ("/api/batch", "")]).write.parquet(f"{tmp_path}/in")
    streaming.start_ingest(stream_requests(spark, f"{tmp_path}/in"), str(tmp_path)).awaitTermination()
    assert held and all("body" in columns and "history" not in columns for columns in held)
    assert queues.consume(spark, str(tmp_path), FLOW1_P1_TO_P2).count() == 4
