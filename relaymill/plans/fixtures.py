"""Requests, messages and deliveries derived from the ``events`` table.

Row rules follow FIXTURES.md. Everything is computed by Spark from the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relaymill.functions import audit
from relaymill.functions.identity import message_id
from relaymill.operators import messages as M
from relaymill.schema import PATH_BATCH, PATH_FLOW1, PATH_FLOW2

REDELIVERY_OFFSET = 1_000_000_000
# Events that one task takes on. An event has some twenty bytes in its file, and what it becomes has
# some thousand, which tasks sort; so tasks are bounded by rows and not by bytes of the input.
ROWS_PER_TASK = 50_000


def _divides(n: int) -> Column:
    return F.col("seq") % n == 0


def spread(rows: DataFrame, key: str = "seq") -> DataFrame:
    """Use all cores, and as many tasks as keep each below ``ROWS_PER_TASK``, where the files
    give fewer tasks.

    Handling a record costs far more than moving it, and a file of one row group cannot be
    split by the scan. Inputs that are split finely enough stay as they are and
    are not shuffled. The key must be close to unique; hashing it sends a record to the
    same task again when a lost one is run once more.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    wanted = max(cores, tasks_for(rows.count()))
    if rows.rdd.getNumPartitions() >= wanted:
        return rows
    return rows.repartition(wanted, key)


def tasks_for(n_rows: int) -> int:
    """Tasks that keep each below ``ROWS_PER_TASK``."""
    return max(1, -(-n_rows // ROWS_PER_TASK))


def parts(spark: SparkSession, sf_dir: str) -> int:
    """The same for all events: of the files or buckets to which what they become is dealt."""
    return tasks_for(_table(spark, sf_dir).count())


def _table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(_table(spark, sf_dir), "event_id").select(
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("clock"),
        F.when(F.col("event_type").isin("purchase", "error"), F.lit(2))
        .otherwise(F.lit(1))
        .alias("flow"),
        "event_type",
        F.col("value").alias("v"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request records, with every kind of well- and ill-formed body in them."""
    e = events(spark, sf_dir)
    path = F.concat(
        F.when(_divides(101), F.lit("/api/unknown"))
        .when(F.col("flow") == 1, F.lit(PATH_FLOW1))
        .otherwise(F.lit(PATH_FLOW2)),
        F.when(_divides(7), F.lit("/")).otherwise(F.lit("")),
    )
    number = F.when(
        F.col("flow") == 1, F.concat(F.lit('"counter": '), F.col("k").cast("string"))
    ).otherwise(F.concat(F.lit('"value": '), F.col("v").cast("string")))
    text = F.concat(F.lit('"initial_data": "'), F.col("event_type"), F.lit('"'))
    item = F.col("seq").cast("string")
    item_json = (
        F.when(_divides(79), F.lit('"12.7"'))
        .when(_divides(73), F.lit("null"))
        .when(_divides(11), F.concat(F.lit('"'), item, F.lit('"')))
        .otherwise(item)
    )
    plain = F.concat(
        F.lit('{"item_id": '), item_json, F.lit(", "), text, F.lit(", "), number, F.lit("}")
    )
    body = (
        F.when(_divides(97), F.lit("{bad json"))
        .when(_divides(89), F.lit(""))
        .when(_divides(83), F.lit("[1,2]"))
        .otherwise(plain)
    )
    return e.select("seq", path.alias("path"), body.alias("body"), F.col("clock").alias("received_at"))


def odd_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with numbers as bare words and in digits of other scripts."""
    e = events(spark, sf_dir)
    item = F.translate(F.col("seq").cast("string"), "0123456789", "٠١٢٣٤٥٦٧٨٩")
    number = (
        F.when(_divides(11), F.lit("NaN"))
        .when(_divides(7), F.lit("-Infinity"))
        .when(_divides(5), F.concat(F.lit('"'), F.translate(F.col("k").cast("string"), "0123456789", "０１２３４５６７８９"), F.lit('"')))
        .otherwise(F.col("k").cast("string"))
    )
    body = F.concat(
        F.lit('{"initial_data": "NaN, \\"Infinity\\" and \\\\", "item_id": "'), item, F.lit('", "counter": '),
        F.when(F.col("flow") == 1, number).otherwise(F.lit("1")), F.lit(', "value": '),
        F.when(F.col("flow") == 2, number).otherwise(F.lit("1.5")), F.lit("}"),
    )
    path = F.when(F.col("flow") == 1, F.lit(PATH_FLOW1)).otherwise(F.lit(PATH_FLOW2))
    return e.select("seq", path.alias("path"), body.alias("body"), F.col("clock").alias("received_at"))


def batch_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One batch request per event; the count comes from the event's ``k``."""
    e = events(spark, sf_dir)
    count = (F.col("k") % 8).cast("string")
    body = (
        F.when(_divides(13), F.lit(""))
        .when(_divides(11), F.lit('{"count": null}'))
        .when(_divides(7), F.concat(F.lit('{"count": "'), count, F.lit('"}')))
        .when(_divides(5), F.concat(F.lit('{"count": -'), count, F.lit("}")))
        .otherwise(F.concat(F.lit('{"count": '), count, F.lit("}")))
    )
    return e.select(
        "seq", F.lit(PATH_BATCH).alias("path"), body.alias("body"), F.col("clock").alias("received_at")
    )


def large_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some batch requests of up to 35,000 items under arrival numbers beyond 40 bits."""
    e = events(spark, sf_dir)
    body = F.concat(F.lit('{"count": '), (F.col("k") * 100 + 25_000).cast("string"), F.lit("}"))
    return e.select(
        (F.col("seq") + F.when(F.col("seq") % 2000 == 0, F.lit(1 << 40)).otherwise(F.lit(0))).alias("seq"),
        F.lit(PATH_BATCH).alias("path"),
        F.when(F.col("seq") % 1000 == 0, body).otherwise(F.lit('{"count": 0}')).alias("body"),
        F.col("clock").alias("received_at"),
    )


def all_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every single request, and every batch request under a later arrival number."""
    batches = batch_requests(spark, sf_dir)
    later = batches.withColumn("seq", F.col("seq") + REDELIVERY_OFFSET)
    return requests(spark, sf_dir).unionByName(later)


def messages(spark: SparkSession, sf_dir: str, flow: int | None = None) -> DataFrame:
    """Well-formed messages, of one flow or both, as built by stage 1."""
    e = events(spark, sf_dir)
    if flow is not None:
        e = e.where(F.col("flow") == flow)
    return M.with_missing_columns(
        e.select(
            "seq",
            F.lit(0).cast("bigint").alias("position"),
            "clock",
            "flow",
            message_id(F.col("seq")).alias("message_id"),
            F.col("seq").alias("item_id"),
            F.col("event_type").alias("initial_data"),
            F.when(F.col("flow") == 1, F.col("k")).alias("counter"),
            F.when(F.col("flow") == 2, F.col("v")).alias("value"),
            audit.started(F.col("clock")).alias("history"),
        )
    )


def records(spark: SparkSession, sf_dir: str, flow: int) -> DataFrame:
    """The same messages as JSON documents in the flow's first queue."""
    return M.encode(messages(spark, sf_dir, flow)).select("seq", "position", "clock", "body")


def ordered_records(spark: SparkSession, sf_dir: str, flow: int) -> DataFrame:
    """Documents with members in an order and a spelling of their own, look-alikes of the touched
    ones in strings and nested objects; some without a number or with an empty trail."""
    e = events(spark, sf_dir).where(F.col("flow") == flow)
    key, number = ("counter", F.col("k")) if flow == 1 else ("value", F.col("v"))
    trail = F.when(_divides(3), F.lit("[ ]")).otherwise(F.to_json(audit.started(F.col("clock"))))
    body = F.concat(
        F.lit('{ "tag" : {"b":[1, 2.50 ,"counter"], "value": {"history":[]}, "a":"x\\"counter\\":\\\\"} , "history":'),
        trail,
        F.when(_divides(5), F.lit("")).otherwise(F.concat(F.lit(f',  "{key}":\t'), number.cast("string"), F.lit(" "))),
        F.lit(',"\u00e9":"\\u00e9\\/", "flow":'), F.col("flow").cast("string"),
        F.lit(',"message_id":"'), message_id(F.col("seq")), F.lit('","item_id": '), F.col("seq").cast("string"),
        F.lit(', "zero":1.500E+2 }'),
    )
    return e.select("seq", F.lit(0).cast("bigint").alias("position"), "clock", body.alias("body"))


def faulty_records(spark: SparkSession, sf_dir: str, flow: int) -> DataFrame:
    """Documents for a stage-2 queue, some of which break a rule of some stage."""
    e = events(spark, sf_dir).where(F.col("flow") == flow)
    key, plain = ("counter", F.col("k")) if flow == 1 else ("value", F.col("v"))
    rule = F.lit(None).cast("int")
    for n in (23, 29, 31, 37, 41, 43, 47, 53, 59, 61):  # the largest divisor is tested first
        rule = F.when(_divides(n), F.lit(n)).otherwise(rule)
    e = e.withColumn("_rule", F.coalesce(rule, F.lit(0)))
    has = F.col("_rule")

    def member(name: str, value: Column) -> Column:
        return F.concat(F.lit(f'"{name}":'), value)

    def quoted(value: Column) -> Column:
        return F.concat(F.lit('"'), value, F.lit('"'))

    members = [
        member("flow", F.lit(str(flow))),
        member("message_id", quoted(message_id(F.col("seq")))),
        F.when(has == 31, member("item_id", F.lit('"12d"')))
        .when(has == 29, member("item_id", F.lit('"0x1p3"')))
        .when(has == 23, member("item_id", F.lit("99999999999999999999")))
        .when(has != 43, member("item_id", F.col("seq").cast("string"))),
        member(
            "initial_data",
            quoted(F.when(has == 47, F.repeat(F.lit("x"), 256)).otherwise(F.col("event_type"))),
        ),
        F.when(has == 59, member(key, F.lit("null")))
        .when(has == 37, member(key, F.lit("1e400")))
        .when(has != 53, member(key, plain.cast("string"))),
        F.when(has == 41, member("tag", quoted(F.col("event_type")))),
        F.when(has != 61, member("history", F.to_json(audit.started(F.col("clock"))))),
    ]
    body = F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}"))
    return e.select("seq", F.lit(0).cast("bigint").alias("position"), "clock", body.alias("body"))


def redelivered(messages_: DataFrame) -> DataFrame:
    """A second delivery of every tenth message: later, changed, one hour on."""
    again = messages_.where(_divides(10))
    return again.withColumns(
        {
            "item_id": F.col("item_id") + 1,
            "initial_data": F.lit("changed"),
            "counter": F.col("counter") + 1,
            "value": F.col("value") + 1.0,
            "clock": F.col("clock") + F.expr("INTERVAL 1 HOUR"),
            "seq": F.col("seq") + REDELIVERY_OFFSET,
        }
    )


def respelled(rows: DataFrame) -> DataFrame:
    """Table rows of which every second one has its id in capitals, with spaces behind it."""
    other = F.concat(F.upper("message_id"), F.lit("  "))
    return rows.withColumn("message_id", F.when(_divides(20), other).otherwise(F.col("message_id")))


def clear_numbers(rows: DataFrame) -> DataFrame:
    """Redelivered table rows with counter and metric NULL for every thirtieth message."""
    again = (F.col("seq") >= REDELIVERY_OFFSET) & (
        (F.col("seq") - REDELIVERY_OFFSET) % 30 == 0
    )
    return rows.withColumns(
        {
            c: F.when(~again, F.col(c))
            for c in ("counter_value", "metric_value")
            if c in rows.columns
        }
    )


def changed_copy(rows: DataFrame) -> DataFrame:
    """A copy of the result table with rows missing and numbers raised."""
    changed = F.col("id") % 700 == 1
    return rows.where(F.col("id") % 500 != 0).withColumns(
        {
            "counter_value": F.when(
                changed & (F.col("flow_id") == 1), F.col("counter_value") + 1
            ).otherwise(F.col("counter_value")),
            "metric_value": F.when(
                changed & (F.col("flow_id") == 2),
                (F.col("metric_value") + F.lit(1).cast("decimal(1,0)")).cast("decimal(10,2)"),
            ).otherwise(F.col("metric_value")),
        }
    )
