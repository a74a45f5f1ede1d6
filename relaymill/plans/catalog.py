"""Registered queries: every operator, run over the whole given tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relaymill.functions import audit
from relaymill.operators import ingest, inspect, messages as M, persist, replicas
from relaymill.plans import fixtures, flows
from relaymill.schema import AUDIT_KEYS, HANDLERS, LAST_STAGE, ROUTES, next_queue
from relaymill.session import configure, work_dir
from relaymill.sources import queues, table as T
from relaymill.sources.bucketed import BucketedTable
from relaymill.sources.requests import stream_requests
from relaymill.streaming import flow as streaming

Query = Callable[[SparkSession, str], DataFrame]
# Fixed value: how the declared table compares its keys.
COLLATION = "UNICODE_CI_RTRIM"
# What a micro-batch takes on at most: the handlers' counterpart of a prefetch limit.
_TRIGGER_BYTES = 256 << 20


def _clock() -> Column:
    return F.col("clock")


def _trail(name: str = "history") -> Column:
    return audit.to_json(F.col(name)).alias(name)


def _wall(name: str = "created_at") -> Column:
    """Timestamps leave as wall-clock values, whatever zone the caller reads them in."""
    return F.col(name).cast("timestamp_ntz").alias(name)


def _read(key: str, type_: str) -> Column:
    """A key of a message as its typed column, or as it was read from the queue."""
    read = F.try_variant_get(F.col(f"read_{key}"), "$", type_)
    return F.coalesce(F.col(key), read).alias(key)


# --- ingest ---------------------------------------------------------------------------


def request_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.outcomes(fixtures.requests(spark, sf_dir))


def ingest_flow1(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = ingest.direct_messages(fixtures.requests(spark, sf_dir), flows=(1,))
    return made.select(
        "seq", "flow", "message_id", "item_id", "initial_data", "counter", _trail()
    )


def ingest_flow2(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = ingest.direct_messages(fixtures.requests(spark, sf_dir), flows=(2,))
    return made.select(
        "seq", "flow", "message_id", "item_id", "initial_data", "value", _trail()
    )


def ingest_odd_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with bare words and other digits: their outcomes, what the messages hold and
    what the table says to them."""
    requests = fixtures.odd_requests(spark, sf_dir)
    codes = ingest.outcomes(requests).select("seq", "status_code")
    made = flows.finish(ingest.direct_messages(requests), None, _clock())
    shown = made.select("seq", "item_id", "counter_value", "metric_value", "initial_data", "reject_reason")
    return codes.join(shown, "seq", "left")


def batch_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = ingest.batch_messages(fixtures.batch_requests(spark, sf_dir))
    return made.select(
        "seq", "position", "flow", "message_id", "item_id", "initial_data", "counter", "value"
    )


def batch_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches beyond one range of numbers, and arrival numbers beyond 40 bits: how many
    messages each makes, and from which item to which."""
    made = ingest.batch_messages(fixtures.large_batches(spark, sf_dir))
    return made.groupBy("seq", "flow").agg(
        F.count(F.lit(1)).alias("messages"),
        F.min("position").alias("first"),
        F.max("position").alias("last"),
        F.sum("item_id").alias("items"),
    )


def batch_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.outcomes(fixtures.batch_requests(spark, sf_dir)).select(
        "seq", "status_code", "messages"
    )


def ingest_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All single and batch requests in one stream, as documents for the first queues."""
    made = M.with_document(ingest.ingest(fixtures.all_requests(spark, sf_dir)), "body")
    document = F.try_parse_json("body")
    return made.select(
        "seq",
        "position",
        "flow",
        F.try_variant_get(document, "$.message_id", "string").alias("message_id"),
        F.try_variant_get(document, "$.item_id", "bigint").alias("item_id"),
        F.try_variant_get(document, "$.initial_data", "string").alias("initial_data"),
        F.try_variant_get(document, "$.counter", "bigint").alias("counter"),
        F.try_variant_get(document, "$.value", "double").alias("value"),
        F.get_json_object("body", "$.history").alias("history"),
    )


# --- queues and stages ----------------------------------------------------------------


def queue_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way of every message through the queue folders: written, read and handed on."""
    root = _run_root(spark, "routing")
    made = ingest.direct_messages(fixtures.requests(spark, sf_dir))
    hops = []
    for flow, route in ROUTES.items():
        waiting = M.encode(made.where(F.col("flow") == flow))
        for queue in route:
            queues.publish(waiting, root, queue)
            taken = queues.consume(spark, root, queue)
            hops.append(
                taken.select(
                    "seq",
                    F.get_json_object("body", "$.message_id").alias("message_id"),
                    F.lit(flow).alias("flow"),
                    F.lit(HANDLERS[queue][1]).alias("stage"),
                    F.lit(queue).alias("consumed_from"),
                    F.lit(next_queue(queue)).cast("string").alias("forwarded_to"),
                )
            )
            if next_queue(queue):
                waiting = flows.forward(taken, queue, _clock())
    return reduce(DataFrame.unionByName, hops)


def flow1_reflect(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = fixtures.records(spark, sf_dir, 1)
    done = flows.handle(records, ROUTES[1][0], _clock())
    return audit.with_full_trail(M.accepted(done)).select(
        "seq",
        _read("message_id", "string"),
        _read("item_id", "bigint"),
        "counter",
        "process2_flow1_reflected",
        _trail(),
    )


def flow2_examine(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = fixtures.records(spark, sf_dir, 2)
    done = flows.handle(records, ROUTES[2][0], _clock())
    return audit.with_full_trail(M.accepted(done)).select(
        "seq",
        _read("message_id", "string"),
        _read("item_id", "bigint"),
        "value",
        "examined_status",
        _trail(),
    )


def flow1_acknowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    hop = flows.forward(fixtures.records(spark, sf_dir, 1), ROUTES[1][0], _clock())
    done = flows.handle(M.accepted(hop).select("seq", "position", "clock", "body"), ROUTES[1][1], _clock())
    return audit.with_full_trail(M.accepted(done)).select(
        "seq",
        _read("message_id", "string"),
        _read("counter", "bigint"),
        "process3_acknowledged",
        _trail(),
    )


def flow2_seal(spark: SparkSession, sf_dir: str) -> DataFrame:
    hop = flows.forward(fixtures.records(spark, sf_dir, 2), ROUTES[2][0], _clock())
    done = flows.handle(M.accepted(hop).select("seq", "position", "clock", "body"), ROUTES[2][1], _clock())
    return audit.with_full_trail(M.accepted(done)).select(
        "seq",
        _read("message_id", "string"),
        _read("value", "double"),
        _read("examined_status", "string"),
        "verified_by",
        "completed",
        _trail(),
    )


def _both_faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faulty documents of both flows as checked table rows."""
    done = [
        flows.finish_records(fixtures.faulty_records(spark, sf_dir, flow), ROUTES[flow][0], _clock())
        for flow in ROUTES
    ]
    return reduce(DataFrame.unionByName, done)


def extra_fields_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An unknown key in the stored document after all stages."""
    rows = M.accepted(_both_faulty(spark, sf_dir)).select("seq", "message_id", "raw_payload")
    return rows.select(
        "seq",
        "message_id",
        F.get_json_object("raw_payload", "$.tag").alias("tag"),
        F.size(F.json_object_keys("raw_payload")).alias("keys"),
    )


def documents_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of documents after stages 2 and 3, changed in place."""

    def texts(flow: int) -> DataFrame:
        records = fixtures.ordered_records(spark, sf_dir, flow)
        for queue in ROUTES[flow][:-1]:
            records = flows.forward(records, queue, _clock(), in_order=True)
            records = M.accepted(records).select("seq", "position", "clock", "body")
        return records.select("seq", "body")

    return texts(1).unionByName(texts(2))


def missing_vs_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stage 2 makes of an absent, a null and a given number."""

    def judged(flow: int, key: str) -> DataFrame:
        done = flows.handle(fixtures.faulty_records(spark, sf_dir, flow), ROUTES[flow][0], _clock())
        read = F.col(f"read_{key}")
        passed = F.col("reject_reason").isNull()
        return done.select(
            "seq",
            F.lit(flow).alias("flow"),
            F.when(read.isNull(), F.lit("absent"))
            .when(F.is_variant_null(read), F.lit("null"))
            .otherwise(F.lit("given"))
            .alias("received"),
            F.when(passed, F.col(key).cast("double")).alias("result"),
            "reject_reason",
        )

    return judged(1, "counter").unionByName(judged(2, "value"))


def rejected_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.rejected(_both_faulty(spark, sf_dir)).select("seq", "stage", "reason")


# --- persist --------------------------------------------------------------------------


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table rows of the well-formed messages of both flows."""
    return flows.finish(fixtures.messages(spark, sf_dir), None, _clock())


def _again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table rows of their redeliveries."""
    again = fixtures.redelivered(fixtures.messages(spark, sf_dir))
    return fixtures.clear_numbers(flows.finish(again, None, _clock()))


def _deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = fixtures.messages(spark, sf_dir)
    every = flows.finish(first.unionByName(fixtures.redelivered(first)), None, _clock())
    return M.accepted(fixtures.clear_numbers(every))


def persist_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    document = F.try_parse_json("raw_payload")
    return _rows(spark, sf_dir).select(
        "seq",
        "message_id",
        "flow_id",
        "item_id",
        "initial_data",
        "counter_value",
        "metric_value",
        "examined_status",
        "verified_by",
        _trail("history_trail"),
        _wall(),
        F.try_variant_get(document, "$.process2_flow1_reflected", "boolean").alias("reflected"),
        F.try_variant_get(document, "$.process3_acknowledged", "boolean").alias("acknowledged"),
        F.try_variant_get(document, "$.completed", "boolean").alias("completed"),
        F.coalesce(
            F.try_variant_get(document, "$.counter", "double"),
            F.try_variant_get(document, "$.value", "double"),
        ).alias("number"),
    )


_TABLE = (
    "id",
    "message_id",
    "flow_id",
    "item_id",
    "initial_data",
    "counter_value",
    "metric_value",
    "examined_status",
    "verified_by",
)


def _shown(rows: DataFrame, *more: str) -> DataFrame:
    """Table cells, and what the stored document says itself: its number, its flag, its
    number of audit entries."""
    layout = "counter: double, value: double, process3_acknowledged: boolean, completed: boolean"
    # Each document is parsed and walked over once. Entries are counted only: of a type that none
    # has, they are not read.
    document = F.try_variant_get(F.try_parse_json("raw_payload"), "$", f"struct<{layout}, history: array<boolean>>")
    return rows.withColumn("_said", document).select(
        *_TABLE,
        *more,
        _trail("history_trail"),
        _wall(),
        F.coalesce("_said.counter", "_said.value").alias("payload_number"),
        F.coalesce("_said.process3_acknowledged", "_said.completed").alias("payload_flag"),
        F.array_size("_said.history").alias("payload_steps"),
    )


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(persist.upsert(_deliveries(spark, sf_dir)))


def redelivered_same_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries that arrive again, changed, under the place they had: the later wins."""
    root = _run_root(spark, "again")
    table = T.ProcessedTable(spark, root)
    table.deliver(_rows(spark, sf_dir), "queue", 0)
    again = _again(spark, sf_dir).withColumn("seq", F.col("seq") - fixtures.REDELIVERY_OFFSET)
    table.deliver(again.repartition(3, "item_id"), "queue", 1)
    return _shown(table.current())


def table_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot of the first deliveries with the second ones on top."""
    table = T.ProcessedTable(spark, _run_root(spark, "current"))
    table.deliver(_rows(spark, sf_dir), "first", 0)
    table.compact()
    table.deliver(_again(spark, sf_dir), "again", 0)
    return _shown(table.current())


def table_recompacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after a second snapshot, once older versions and their log are retired."""
    table = T.ProcessedTable(spark, _run_root(spark, "recompacted"))
    table.deliver(_rows(spark, sf_dir), "first", 0)
    table.compact()
    table.deliver(_again(spark, sf_dir), "again", 0)
    table.compact()
    table.retire(versions=1)
    return _shown(table.scan())


def _bucketed(spark: SparkSession, sf_dir: str, collation: str | None = None) -> BucketedTable:
    """A new table; a bucket is what one task sorts, so their number goes with the events."""
    root = _run_root(spark, "bucketed")
    database = "relaymill_" + root[-36:].replace("-", "_")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), fixtures.parts(spark, sf_dir))
    return BucketedTable(spark, f"{database}.processed_messages", root, buckets, collation)


def upsert_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A base of the first deliveries, merged bucket by bucket with the second ones."""
    table = _bucketed(spark, sf_dir)
    table.upsert(M.accepted(_rows(spark, sf_dir)))
    table.merge()
    table.upsert(M.accepted(_again(spark, sf_dir)))
    return _shown(table.scan())


def upsert_collated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a key that ignores case and trailing spaces: some of the second
    deliveries spell their ids otherwise, and a base is made of both."""
    table = _bucketed(spark, sf_dir, COLLATION)
    table.upsert(M.accepted(_rows(spark, sf_dir)))
    table.upsert(fixtures.respelled(M.accepted(_again(spark, sf_dir))))
    table.merge()
    return _shown(table.scan())


def _end_to_end(spark: SparkSession, sf_dir: str, flow: int) -> DataFrame:
    made = ingest.direct_messages(fixtures.requests(spark, sf_dir), flows=(flow,))
    rows = flows.finish(made, flow, _clock())
    return _shown(persist.upsert(M.accepted(rows)))


def end_to_end_flow1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _end_to_end(spark, sf_dir, 1)


def end_to_end_flow2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _end_to_end(spark, sf_dir, 2)


# --- inspection -----------------------------------------------------------------------

_built: dict[tuple[str, str], T.ProcessedTable] = {}


def processed_table(spark: SparkSession, sf_dir: str) -> T.ProcessedTable:
    """The result table of all deliveries, written once per application and data folder
    and then only read, the way inspection queries find it."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _built:
        name = key[1].rpartition("/")[2]
        found = T.ProcessedTable(spark, f"{work_dir(spark)}/tables/{name}")
        if found.version() == 0:
            found.deliver(_rows(spark, sf_dir), "first", 0)
            found.deliver(_again(spark, sf_dir), "again", 0)
            found.compact()
        _built[key] = found
    return _built[key]


def _scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return processed_table(spark, sf_dir).scan()


def table_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_scan(spark, sf_dir))


def table_declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The declared table in the catalog: it shows a first snapshot, then the second one."""
    root = _run_root(spark, "declared")
    name = "relaymill_" + root[-36:].replace("-", "_") + ".processed_messages"
    table = T.ProcessedTable(spark, root)
    T.create_table(spark, name)
    for source, rows in (("first", _rows(spark, sf_dir)), ("again", _again(spark, sf_dir))):
        table.deliver(rows, source, 0)
        table.compact()
        table.publish_as(name)
    return _shown(spark.table(name))


def latest_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.latest(_scan(spark, sf_dir), 10).withColumn("created_at", _wall())


def latest_flow1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reparsed(inspect.latest_of_flow(_scan(spark, sf_dir), 1))


def latest_flow2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reparsed(inspect.latest_of_flow(_scan(spark, sf_dir), 2))


def _reparsed(details: DataFrame) -> DataFrame:
    """Indented trails read back with all keys, so that they compare by content."""
    keys = ", ".join(f"{key}: string" for key in AUDIT_KEYS)
    entries = F.from_json("audit_trail", f"array<struct<{keys}>>")
    return details.withColumn("audit_trail", F.to_json(entries))


def lookup_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The message that event 41 became, by its id."""
    digest = hashlib.md5(b"msg-41").hexdigest()
    wanted = "-".join((digest[:8], digest[8:12], digest[12:16], digest[16:20], digest[20:]))
    return _shown(inspect.by_message(_scan(spark, sf_dir), wanted))


def lookup_flow_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(inspect.by_flow_item(_scan(spark, sf_dir), 1, 41))


def created_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(
        inspect.created_between(
            _scan(spark, sf_dir), "2024-01-10 00:00:00", "2024-01-12 00:00:00"
        )
    )


def flow_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_scan(spark, sf_dir).where(F.col("flow_id") == 2))


def audit_step_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.audit_step_counts(_scan(spark, sf_dir))


def audit_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.audit_steps(_scan(spark, sf_dir))


def audit_pretty(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scan(spark, sf_dir)
    return _reparsed(inspect.detail(rows, 1).unionByName(
        inspect.detail(rows, 2), allowMissingColumns=True
    ).select("message_id", "audit_trail"))


def replica_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scan(spark, sf_dir)
    return inspect.compare_copies({"left": rows, "right": fixtures.changed_copy(rows)})


def replica_digest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from stored digests of the copies; rows move in unequal ranges only."""
    rows = _scan(spark, sf_dir)
    copies = {"left": rows, "right": fixtures.changed_copy(rows)}
    root, stored = _run_root(spark, "digests"), {}
    for name, copy in copies.items():
        replicas.digests(copy).write.parquet(f"{root}/{name}")
        stored[name] = spark.read.parquet(f"{root}/{name}")
    return replicas.compare_by_digests(copies, found=stored)


def replica_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest rows of three copies, two of them alike."""
    rows = _scan(spark, sf_dir)
    short = rows.where(F.col("id") % 3 != 0)
    return inspect.compare_latest({"node1": rows, "node2": rows, "node3": short}, 5)


# --- streaming ------------------------------------------------------------------------


def _run_root(spark: SparkSession, name: str) -> str:
    """A fresh folder for one run of a streaming query."""
    started = spark.range(1).select(F.expr("uuid()")).first()[0]
    return f"{work_dir(spark)}/streams/{name}-{started}"


def stream_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of both flows through six streaming handlers into the table."""
    root = _run_root(spark, "flow")
    _fill_first_queues(spark, sf_dir, root)
    done = streaming.drain(spark, root, _clock(), max_bytes=_TRIGGER_BYTES)
    return _shown(done.current())


def stream_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same documents, some of them faulty, through the handlers into the bucketed table of
    the catalog, in several micro-batches."""
    root = _run_root(spark, "bucketed-flow")
    parts = max(4, fixtures.parts(spark, sf_dir))
    for flow, route in ROUTES.items():
        waiting = fixtures.faulty_records(spark, sf_dir, flow).repartition(parts, "seq")
        queues.publish(waiting, root, route[0])
    table = _bucketed(spark, sf_dir)
    taken = _files_at_once(spark, parts)
    refused = streaming.drain(spark, root, _clock(), max_files=taken, into=table).rejected()
    table.merge_if_due()
    rows = table.scan().select("id", "message_id", "item_id", "counter_value", "metric_value")
    again = refused.select("seq", "reason").withColumnRenamed("seq", "id")
    return rows.unionByName(again, allowMissingColumns=True)


def _files_at_once(spark: SparkSession, files: int) -> int:
    """Files of a micro-batch: three of the least number, of more some for each core."""
    return min(files - 1, max(3, 4 * spark.sparkContext.defaultParallelism))


def _fill_first_queues(spark: SparkSession, sf_dir: str, root: str) -> None:
    files = max(spark.sparkContext.defaultParallelism, fixtures.parts(spark, sf_dir))
    for flow, route in ROUTES.items():
        waiting = fixtures.records(spark, sf_dir, flow).repartition(files, "seq")
        queues.publish(waiting, root, route[0])


def stream_competing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three consumers on each of the last queues, into one log. Of the second half of the
    documents two take their parts while the third is stopped; it resumes after them."""
    root, consumers = _run_root(spark, "competing"), 3
    files = max(4 * consumers, fixtures.parts(spark, sf_dir))
    table = T.ProcessedTable(spark, root)
    ready = {}
    for flow, route in ROUTES.items():
        waiting = fixtures.records(spark, sf_dir, flow)
        for queue in route[:-1]:
            waiting = M.accepted(flows.forward(waiting, queue, _clock()))
        ready[route[-1]] = waiting.select("seq", "position", "clock", "body")
    for half, working in ((0, (0, 1, 2)), (1, (0, 1)), (None, (2,))):
        for queue, waiting in ready.items():
            if half is not None:
                part = waiting.where(F.col("seq") % 2 == half)
                queues.publish(part.repartition(files, "seq"), root, queue)
        running = [
            streaming.start_persist(spark, root, queue, _clock(), share=(k, consumers))
            for queue in ready
            for k in working
        ]
        for query in running:
            query.awaitTermination()
    return _shown(table.current())


def stream_ingest_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All requests as files, judged once, through six handlers into the table."""
    root = _run_root(spark, "requests")
    cores = spark.sparkContext.defaultParallelism
    files = 2 * max(2, cores // 2, fixtures.parts(spark, sf_dir))
    every = fixtures.all_requests(spark, sf_dir).repartition(files, "seq")
    every.write.parquet(f"{root}/requests")
    taken = min(files // 2, max(2, 4 * cores))  # a micro-batch is half of them, or a bounded part
    arriving = stream_requests(spark, f"{root}/requests", max_files=taken)
    streaming.start_ingest(arriving, root).awaitTermination()
    done = streaming.drain(spark, root, _clock(), max_bytes=_TRIGGER_BYTES)
    return _shown(done.current(), "position")


def stream_json_queues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of both flows in JSON files through streaming handlers into JSON files."""
    root = _run_root(spark, "json")
    taken = []
    for flow, (first, second, _) in ROUTES.items():
        queues.publish(fixtures.records(spark, sf_dir, flow), root, first, "json")
        streaming.start_hop(spark, root, first, _clock(), format="json").awaitTermination()
        taken.append(queues.consume(spark, root, second, "json"))
    return reduce(DataFrame.unionByName, taken).select(
        "seq",
        F.get_json_object("body", "$.message_id").alias("message_id"),
        F.get_json_object("body", "$.counter").cast("bigint").alias("counter"),
        F.get_json_object("body", "$.value").cast("double").alias("value"),
        F.get_json_object("body", "$.history").alias("history"),
        F.col("clock").cast("timestamp_ntz").alias("clock"),
    )


def stream_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faulty documents through the streaming handlers: what each of them set aside."""
    root = _run_root(spark, "faults")
    for flow, route in ROUTES.items():
        queues.publish(fixtures.faulty_records(spark, sf_dir, flow), root, route[0])
    done = streaming.drain(spark, root, _clock(), max_bytes=_TRIGGER_BYTES)
    parts = [done.rejected()] + [
        queues.dead_letters(spark, root, queue)
        for queue, (_, stage) in HANDLERS.items()
        if 2 < stage <= LAST_STAGE
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("seq", "stage", "reason")


def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries, then redeliveries, through the stateful upsert: it is stopped after the
    first and resumes from its checkpoint for the second."""
    return _upserted(spark, [M.accepted(_rows(spark, sf_dir)), M.accepted(_again(spark, sf_dir))])


def stream_upsert_collated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with respelled ids and a state whose key ignores case and trailing spaces."""
    again = fixtures.respelled(M.accepted(_again(spark, sf_dir)))
    return _upserted(spark, [M.accepted(_rows(spark, sf_dir)), again], COLLATION)


def _upserted(spark: SparkSession, parts: list[DataFrame], collation: str | None = None) -> DataFrame:
    root = _run_root(spark, "upsert")
    columns = [f for f in T.DELIVERY.fields if f.name in ("seq", *_delivered())]
    layout = ",".join(f"{f.name} {f.dataType.simpleString()}" for f in columns)
    for part in parts:
        part.select(*[f.name for f in columns]).write.mode("append").parquet(f"{root}/deliveries")
        reader = spark.readStream.schema(layout).option("maxBytesPerTrigger", 4 * _TRIGGER_BYTES)
        arriving = reader.parquet(f"{root}/deliveries")
        streaming.start_upsert(arriving, root, collation=collation).awaitTermination()
    return _shown(streaming.upserted(spark, root))


def _delivered() -> list[str]:
    return [n for n in T.PROCESSED.names if n != "id"]


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        request_outcome,
        ingest_flow1,
        ingest_flow2,
        ingest_odd_numbers,
        batch_outcome,
        batch_generate,
        batch_large,
        ingest_all,
        queue_routing,
        flow1_reflect,
        flow2_examine,
        flow1_acknowledge,
        flow2_seal,
        extra_fields_kept,
        documents_in_order,
        missing_vs_null,
        rejected_messages,
        persist_projection,
        upsert_latest,
        upsert_bucketed,
        upsert_collated,
        redelivered_same_seq,
        table_current,
        table_recompacted,
        end_to_end_flow1,
        end_to_end_flow2,
        table_scan,
        table_declared,
        latest_n,
        latest_flow1,
        latest_flow2,
        flow_rows,
        lookup_message,
        lookup_flow_item,
        created_range,
        audit_step_count,
        audit_steps,
        audit_pretty,
        replica_diff,
        replica_digest_diff,
        replica_latest,
        stream_end_to_end,
        stream_bucketed,
        stream_competing,
        stream_ingest_end_to_end,
        stream_json_queues,
        stream_rejected,
        stream_upsert,
        stream_upsert_collated,
    )
}


def queries() -> dict[str, Query]:
    def with_settings(query: Query) -> Query:
        return lambda spark, sf_dir: query(configure(spark), sf_dir)

    return {name: with_settings(query) for name, query in QUERIES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All requests, single and batch, through all stages, upserted; the ten newest rows."""
    configure(spark)
    made = ingest.ingest(fixtures.all_requests(spark, sf_dir))
    rows = M.accepted(flows.finish(made, None, _clock()))
    return inspect.latest(persist.upsert(rows), 10).withColumn("created_at", _wall())
