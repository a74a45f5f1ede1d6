import pytest

from relaymill.llm.tables import BATCH_BYTES, bounded_batches, materialised


@pytest.mark.parametrize("before,after", [("64m", BATCH_BYTES), ("1g", BATCH_BYTES), ("4MB", "4MB"), ("1000b", "1000b"), ("9000000", BATCH_BYTES)])
def test_batches_are_bounded_but_never_enlarged(spark, before, after):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    kept = spark.conf.get(key)
    try:
        spark.conf.set(key, before)
        bounded_batches(spark)
        assert spark.conf.get(key).lower() in (str(after).lower(), f"{after}b".lower())
    finally:
        spark.conf.set(key, kept)


def test_materialised_tables_keep_rows_and_types(spark):
    made = spark.createDataFrame([(1, None), (2, "x")], "a long, b string")
    again = materialised(made, "test")
    assert again.dtypes == made.dtypes and sorted(again.collect()) == sorted(made.collect())
