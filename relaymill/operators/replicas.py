"""Comparison of copies by digests: only where copies differ do rows move.

The keys are dealt into ranges of a hash. A range's digest is its number of rows, and the sum and
the exclusive or of their hashes, none of which depends on an order. Digests are added up before
they are shuffled; groups of ranges are digested once more, so of equal copies a few rows
are compared and of others only the ranges in which they differ, row by row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaymill.operators.inspect import COMPARED, compare_copies

GROUPS = 64
RANGES = 64  # in each group


def _range(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(GROUPS * RANGES)).cast("int")


def _hash(columns: tuple[str, ...], seed: int) -> Column:
    """Of all cells. NULLs leave a hash as it is, so their places are hashed as well."""
    empty = reduce(lambda x, y: x + y, [F.col(c).isNull().cast("long") * (1 << i) for i, c in enumerate(columns)])
    return F.xxhash64(F.lit(seed), *columns, empty)


def digests(
    rows: DataFrame, columns: tuple[str, ...] = COMPARED, key: str = "message_id"
) -> DataFrame:
    """The digest of each range (`key_range`) and of each group of ranges (`key_range` NULL).

    Small enough to be stored beside a copy or sent to where the other copy is.
    """
    hashed = rows.select(
        _range(key).alias("key_range"),
        _hash(columns, 1).cast("decimal(38,0)").alias("_added"),
        _hash(columns, 2).alias("_mixed"),
    )
    fine = hashed.groupBy("key_range").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("_added").alias("added"), F.bit_xor("_mixed").alias("mixed")
    )
    fine = fine.withColumn("key_group", F.floor(F.col("key_range") / RANGES).cast("int"))
    coarse = fine.groupBy("key_group").agg(
        F.sum("rows").alias("rows"), F.sum("added").alias("added"), F.bit_xor("mixed").alias("mixed"),
        F.lit(None).cast("int").alias("key_range"),
    )
    return coarse.unionByName(fine)


def _unequal(found: dict[str, DataFrame], at: str) -> DataFrame:
    """Values of `at` whose digests are not the same in all copies, or missing in one."""
    tagged = [d.select(at, F.struct("rows", "added", "mixed").alias("_digest")) for d in found.values()]
    together = reduce(DataFrame.unionByName, tagged).groupBy(at)
    counted = together.agg(
        F.count(F.lit(1)).alias("_n"), F.min("_digest").alias("_low"), F.max("_digest").alias("_high")
    )
    return counted.where((F.col("_n") < len(found)) | (F.col("_low") != F.col("_high"))).select(at)


def unequal_ranges(found: dict[str, DataFrame]) -> DataFrame:
    """Ranges in which copies differ, from their digests: by groups first, then within these."""
    groups = _unequal({k: d.where("key_range IS NULL") for k, d in found.items()}, "key_group")
    few = F.broadcast(groups)  # GROUPS rows at most
    return _unequal(
        {k: d.where("key_range IS NOT NULL").join(few, "key_group", "left_semi") for k, d in found.items()},
        "key_range",
    )


def suspects(rows: DataFrame, ranges: DataFrame, key: str = "message_id") -> DataFrame:
    """Rows of a copy that lie in the given ranges."""
    few = F.broadcast(ranges)  # GROUPS * RANGES rows at most
    return rows.withColumn("key_range", _range(key)).join(few, "key_range", "left_semi").drop("key_range")


def compare_by_digests(
    copies: dict[str, DataFrame],
    columns: tuple[str, ...] = COMPARED,
    key: str = "message_id",
    found: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """What `compare_copies` finds. `found` has digests of the copies where they are stored."""
    found = found or {name: digests(rows, columns, key) for name, rows in copies.items()}
    ranges = unequal_ranges(found)
    narrow = {name: rows.select(*dict.fromkeys((*columns, key))) for name, rows in copies.items()}
    return compare_copies({name: suspects(rows, ranges, key) for name, rows in narrow.items()}, columns)
