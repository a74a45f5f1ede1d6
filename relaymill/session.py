"""Session settings the message semantics depend on, and the shared work folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Settings that change results, so every entry point applies them.
SEMANTIC_SETTINGS = {
    # Audit timestamps are wall-clock text; one fixed zone keeps them reproducible.
    "spark.sql.session.timeZone": "UTC",
    # A JSON object that repeats a key keeps the last value instead of failing.
    "spark.sql.variant.allowDuplicateKeys": "true",
}

# The JVM never compiles a method above 8000 bytes of bytecode; one generated method for
# a whole chain of stages would run interpreted. Above this limit Spark generates code per
# operator instead, in methods small enough. Measured: 2 to 2.5 times faster end to end.
# Times are written in the form for which parquet keeps the least and greatest of a file;
# Spark's default has none, so filters on time could skip nothing.
# A task sorts the records that it reads, which have ten to twenty times the bytes they have in
# files and in shuffles; Spark's defaults of 128 and 64 MB would let it have half a million.
# Queues and the log are written by outcome, of which there are two: a task keeps a file open for
# each, where Spark would sort all records by it first.
EXECUTION_SETTINGS = {
    "spark.sql.maxConcurrentOutputFileWriters": "4",
    "spark.sql.files.maxPartitionBytes": "16m",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32m",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
}

# A shuffle starts with so many partitions at least; Spark puts small ones together. A number
# that fits small inputs would let what a task sorts after a shuffle grow with big ones.
LEAST_PARTITIONS = 600
_INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"

ROCKSDB_PROVIDER = (
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings above to a session and return it."""
    for key, value in (SEMANTIC_SETTINGS | EXECUTION_SETTINGS).items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    given = (spark.conf.get(key, None) for key in (_INITIAL, "spark.sql.shuffle.partitions"))
    spark.conf.set(_INITIAL, str(max(LEAST_PARTITIONS, *(int(n or 0) for n in given))))
    return spark


def local_session(
    cores: int | str = "*", memory: str = "8g", shared_folder: str | None = None
) -> SparkSession:
    """A session for tests and benches on one machine."""
    partitions = "8" if cores == "*" else str(cores)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("relaymill")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", partitions)
        # call sites in error messages cost about half of the time to build a query
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
    )
    if shared_folder:
        builder = builder.config("spark.checkpoint.dir", shared_folder)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


_own_folders: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """Folder for written tables and streaming checkpoints, visible to every executor.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master may fall back
    to a folder of its own.
    """
    app = spark.sparkContext.applicationId
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        if app not in _own_folders:
            _own_folders[app] = tempfile.mkdtemp(prefix="relaymill-")
        folder = _own_folders[app]
    return f"{folder.rstrip('/')}/relaymill-{app}"
