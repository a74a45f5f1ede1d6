"""Exact rounding against the language's own round()."""

import random
import struct

from pyspark.sql import functions as F

from relaymill.functions.rounding import round_cents


def check(spark, values):
    rows = (
        spark.createDataFrame([(v,) for v in values], "x double")
        .select("x", round_cents(F.col("x")).alias("y"))
        .collect()
    )
    assert len(rows) == len(values)
    wrong = [(r.x, r.y, round(r.x, 2)) for r in rows if r.y != round(r.x, 2)]
    assert wrong == []


def test_scaled_prices_ties_and_negatives(spark):
    values = [cents / 100 * 1.15 for cents in range(-60_000, 60_000)]
    values += [k / 8 for k in range(-20_000, 20_000)]  # exact ties such as 0.125, 0.375
    values += [k / 1000 for k in range(-30_000, 30_000)]
    check(spark, values)


def test_every_magnitude(spark):
    rnd = random.Random(7)
    values = []
    while len(values) < 60_000:
        (x,) = struct.unpack("<d", rnd.getrandbits(64).to_bytes(8, "little"))
        if x == x and abs(x) != float("inf"):
            values.append(x)
    values += [rnd.uniform(-1, 1) * 10**e for e in range(-6, 18) for _ in range(400)]
    values += [2.0**46 + d for d in (-0.0078125, 0.0, 0.015625)] + [0.005, 0.015, 0.025, 1e-300]
    check(spark, values)


def test_not_finite_passes_through(spark):
    rows = spark.createDataFrame(
        [(float("inf"),), (float("-inf"),), (float("nan"),), (None,)], "x double"
    ).select(round_cents(F.col("x")).alias("y"))
    a, b, c, d = [r.y for r in rows.collect()]
    assert a == float("inf") and b == float("-inf") and c != c and d is None
