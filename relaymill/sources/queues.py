"""Durable queues of JSON messages: one folder (or Kafka topic) per registered queue.

A queue folder is partitioned by ``outcome``. Records under ``accepted`` are what the
next handler consumes. Records under ``rejected`` are what the handler feeding this queue
set aside, with stage and reason; a broker without a dead-letter queue would lose them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relaymill.schema import QUEUE_RECORD, handler_of
from relaymill.sources import files

ACCEPTED, REJECTED = "accepted", "rejected"
# JSON files would otherwise cut the clock to milliseconds.
_OPTIONS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}

QUEUE_FILE = T.StructType(
    [
        *QUEUE_RECORD.fields,
        T.StructField("reject_stage", T.IntegerType()),
        T.StructField("reject_reason", T.StringType()),
        T.StructField("outcome", T.StringType()),
    ]
)


def queue_path(root: str, queue: str) -> str:
    """Folder of a registered queue."""
    handler_of(queue)
    return f"{root.rstrip('/')}/queues/{queue}"


def _reader(reader, format: str):
    return reader.schema(QUEUE_FILE).format(format).options(**_OPTIONS)


def with_outcome(records: DataFrame) -> DataFrame:
    """Add the ``outcome`` column; records without reject columns are all accepted."""
    if "reject_reason" not in records.columns:
        records = records.withColumns(
            {
                "reject_stage": F.lit(None).cast("int"),
                "reject_reason": F.lit(None).cast("string"),
            }
        )
    failed = F.col("reject_reason").isNotNull()
    return records.withColumn(
        "outcome", F.when(failed, F.lit(REJECTED)).otherwise(F.lit(ACCEPTED))
    )


def publish(records: DataFrame, root: str, queue: str, format: str = "parquet") -> None:
    """Append records (seq, clock, body, ...) to a queue from a batch job.

    A queue folder written by a streaming query must be fed by that query only: readers
    then go by the stream's own file log.
    """
    out = with_outcome(records).select(*QUEUE_FILE.names)
    writer = out.write.mode("append").partitionBy("outcome").options(**_OPTIONS)
    writer.format(format).save(queue_path(root, queue))


def publish_batch(records: DataFrame, root: str, queue: str, batch_id: int) -> None:
    """Put one micro-batch into a queue, under its number: run again, it replaces itself."""
    out = with_outcome(records).select(*QUEUE_FILE.names)
    path = f"{queue_path(root, queue)}/batch_id={batch_id}"
    out.write.mode("overwrite").partitionBy("outcome").parquet(path)


def open_queue(spark: SparkSession, root: str, queue: str, in_batches: bool = False) -> None:
    """Make the folder of a queue, so that a consumer can wait for its first file. A queue that
    ``publish_batch`` feeds has an empty batch, from which consumers know its folders."""
    path = queue_path(root, queue)
    if files.exists(spark, path):
        return
    if in_batches:
        nothing = spark.createDataFrame([], QUEUE_FILE).drop("outcome").coalesce(1)
        nothing.write.parquet(f"{path}/batch_id=-1/outcome={ACCEPTED}")
    else:
        files.make(spark, path)


def consume(spark: SparkSession, root: str, queue: str, format: str = "parquet") -> DataFrame:
    """Records waiting in a queue."""
    found = _reader(spark.read, format).load(queue_path(root, queue))
    return found.where(F.col("outcome") == ACCEPTED).select(*QUEUE_RECORD.names)


def dead_letters(
    spark: SparkSession, root: str, queue: str, format: str = "parquet"
) -> DataFrame:
    """Records the handler feeding ``queue`` set aside."""
    found = _reader(spark.read, format).load(queue_path(root, queue))
    return found.where(F.col("outcome") == REJECTED).select(
        "seq", F.col("reject_stage").alias("stage"), F.col("reject_reason").alias("reason"), "body"
    )


def _limited(reader, max_files: int | None, max_bytes: int | None):
    if max_files is not None and max_bytes is not None:
        raise ValueError("a micro-batch is bounded by files or by bytes, not by both")
    if max_files is not None:
        return reader.option("maxFilesPerTrigger", max_files)
    return reader if max_bytes is None else reader.option("maxBytesPerTrigger", max_bytes)


def stream_queue(
    spark: SparkSession,
    root: str,
    queue: str,
    max_files: int | None = None,
    format: str = "parquet",
    share: tuple[int, int] | None = None,
    max_bytes: int | None = None,
) -> DataFrame:
    """A queue as a stream. ``max_files`` or ``max_bytes`` bounds what one micro-batch takes on,
    the counterpart of a consumer's prefetch limit. The work goes with the bytes, files may be
    of any size; a single file is always taken whole. ``share`` (k, n) is the k-th of n parts
    of the files, by a hash of their names; the other files are not opened."""
    reader = _limited(_reader(spark.readStream, format), max_files, max_bytes)
    found = reader.load(queue_path(root, queue))
    if share is not None:
        part = F.pmod(F.xxhash64("_metadata.file_name"), F.lit(share[1]))
        found = found.where(part == share[0])
    return found.where(F.col("outcome") == ACCEPTED).select(*QUEUE_RECORD.names)


def sink_queue(records: DataFrame, root: str, queue: str, format: str = "parquet"):
    """Stream writer that publishes to a queue folder, each record exactly once."""
    return (
        with_outcome(records)
        .select(*QUEUE_FILE.names)
        .writeStream.format(format)
        .partitionBy("outcome")
        .outputMode("append")
        .options(path=queue_path(root, queue), **_OPTIONS)
    )


def stream_topic(
    spark: SparkSession, servers: str, queue: str, max_offsets: int | None = None
) -> DataFrame:
    """A Kafka topic named after the queue, where the connector is on the class path.

    A key stays in one topic partition, so offsets order its deliveries; offset and
    partition together make the place unique. Not run here: the connector is not installed.
    """
    handler_of(queue)
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", queue)
        .option("startingOffsets", "earliest")
    )
    if max_offsets is not None:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    return reader.load().select(
        F.col("offset").alias("seq"),
        F.col("partition").cast("bigint").alias("position"),
        F.col("timestamp").alias("clock"),
        F.col("value").cast("string").alias("body"),
    )


def to_topic(records: DataFrame) -> DataFrame:
    """Queue records as rows for a Kafka topic. The key is the message id, so the deliveries of a
    message stay in one topic partition and in order; what a stage refused goes elsewhere."""
    kept = with_outcome(records).where(F.col("outcome") == ACCEPTED)
    return kept.select(F.get_json_object("body", "$.message_id").alias("key"), F.col("body").alias("value"))


def sink_topic(records: DataFrame, servers: str, queue: str):
    """Stream writer to the Kafka topic named after the queue. At least once, as brokers do: the
    upsert at the end makes that once. Not run here: the connector is not installed."""
    handler_of(queue)
    return (
        to_topic(records).writeStream.format("kafka").outputMode("append")
        .option("kafka.bootstrap.servers", servers).option("topic", queue)
    )
