"""Reading the given tables and writing intermediate ones where every executor sees them."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from relaymill.session import work_dir

BATCH_BYTES = 8 << 20
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def bounded_batches(spark: SparkSession) -> None:
    """Hand texts to Python in batches of a few megabytes, however long they are."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(-?\d+)([kmgtp]?)i?b?", spark.conf.get(key).lower()).groups()
    held = int(number) << (10 * " kmgtp".index(unit or " "))
    if not 0 < held <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared work folder."""
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialised(df: DataFrame, name: str) -> DataFrame:
    """Write a DataFrame to the shared folder and read it back.

    This cuts the lineage without depending on any one executor, and gives the planner
    true sizes, so that it broadcasts only what is known to be small.
    """
    bounded_batches(df.sparkSession)
    folder = fresh_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
