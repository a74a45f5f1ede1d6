"""Copies compared by digests."""

from pyspark.sql import functions as F

from relaymill.operators import replicas as R
from relaymill.operators.inspect import compare_copies

LAYOUT = "id long, message_id string, flow_id int, item_id int, counter_value int, metric_value decimal(10,2)"


def copy(spark, n=2000):
    rows = spark.range(n).select(
        F.col("id"), F.concat(F.lit("m"), "id").alias("message_id"), (F.col("id") % 2 + 1).cast("int").alias("flow_id"),
        F.col("id").cast("int").alias("item_id"), F.when(F.col("id") % 2 == 0, F.col("id").cast("int")).alias("counter_value"),
        F.when(F.col("id") % 2 == 1, F.col("id").cast("decimal(10,2)")).alias("metric_value"),
    )
    assert rows.schema.simpleString() == spark.createDataFrame([], LAYOUT).schema.simpleString()
    return rows


def found(copies):
    return sorted(map(tuple, R.compare_by_digests(copies).collect()), key=repr)


def test_digests_do_not_depend_on_order(spark):
    rows = copy(spark)
    first, second = (sorted(R.digests(r).collect(), key=repr) for r in (rows, rows.repartition(7, "item_id")))
    assert first == second
    counted = [sum(r.rows for r in first if (r.key_range is None) == is_group) for is_group in (True, False)]
    assert counted == [2000, 2000]


def test_equal_copies_move_one_row_per_range_and_copy(spark):
    rows = copy(spark).coalesce(1)
    fine = R.digests(rows).where("key_range IS NOT NULL")
    assert fine.count() <= R.GROUPS * R.RANGES
    ranges = R.unequal_ranges({"a": R.digests(rows), "b": R.digests(rows)})
    assert ranges.count() == 0 and R.suspects(rows, ranges).count() == 0
    assert found({"a": rows, "b": rows.repartition(3), "c": rows}) == []


def test_the_same_as_row_by_row_and_only_unequal_ranges_move(spark):
    rows = copy(spark)
    changed = rows.where("id NOT IN (7, 1500)").withColumn(
        "counter_value", F.when(F.col("id") == 42, F.lit(1)).otherwise(F.col("counter_value"))
    )
    swapped = rows.withColumn("message_id", F.when(F.col("id") == 3, F.lit("m5")).when(F.col("id") == 5, F.lit("m3")).otherwise(F.col("message_id")))
    twice = rows.union(rows.where("id = 9"))
    for other in (changed, swapped, twice, rows.limit(0)):
        copies = {"a": rows, "b": other, "c": rows}
        assert found(copies) == sorted(map(tuple, compare_copies(copies).collect()), key=repr) != []
    ranges = R.unequal_ranges({"a": R.digests(rows), "b": R.digests(changed)})
    assert 1 <= ranges.count() <= 3 and R.suspects(rows, ranges).count() < 20


def test_a_value_under_another_column_is_seen(spark):
    """NULLs do not change a hash, so the places of values are part of it."""
    rows = spark.createDataFrame([(1, "m", 1, 1, 5, None)], LAYOUT)
    moved = spark.createDataFrame([(1, "m", 1, 5, None, None)], LAYOUT)
    assert len(found({"a": rows, "b": moved})) == 2
    other = spark.createDataFrame([(1, "m", 1, None, 1, None), (1, "m", None, 1, 1, None)], LAYOUT)
    assert len(found({"a": other.limit(1), "b": other.where("item_id IS NOT NULL")})) == 2
