"""Running totals over a global order in which no task sees more than its range.

`ranged` deals rows into ranges of an order and writes them, so that the ranges stay what
they are however often the table is read. `running` adds to every row the sum over all
earlier rows: the sums of whole ranges are few rows and are added up first, the rest is a
window within one range. A group may therefore hold any part of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relaymill.llm.tables import materialised

PART = "part"


def ranged(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """The rows, written; `part` is the number of the range a row lies in.

    Where many rows may be equal in the order, let it end with a column that is unique:
    rows equal in all its columns share a range.
    """
    return materialised(rows.repartitionByRange(*order).withColumn(PART, F.spark_partition_id()), name)


def running(
    rows: DataFrame,
    order: tuple[str, ...],
    values: dict[str, Column],
    by: tuple[str, ...] = (),
    attached: DataFrame | None = None,
) -> DataFrame:
    """Each row of `ranged` with the sums of `values` over the rows before it.

    `by` sums within groups, which must be a prefix of the order; null is a group too.
    `attached` has further columns per group. They reach the rows by way of the ranges'
    sums, so a large group is not joined on its key.
    """
    before = Window.unboundedPreceding
    summed = rows.groupBy(PART, *by).agg(*[F.sum(v).alias(f"_{n}") for n, v in values.items()])
    earlier = Window.partitionBy(*by).orderBy(PART).rowsBetween(before, -1)
    zero = F.lit(0)
    offsets = summed.select(
        F.col(PART).alias("_part"),
        *[F.col(b).alias(f"_by_{b}") for b in by],
        *[F.coalesce(F.sum(f"_{n}").over(earlier), zero).alias(f"_{n}") for n in values],
    )
    if attached is not None:
        renamed = attached.withColumnsRenamed({b: f"_key_{b}" for b in by})
        same = [F.col(f"_by_{b}").eqNullSafe(F.col(f"_key_{b}")) for b in by]
        offsets = offsets.join(renamed, same).drop(*[f"_key_{b}" for b in by])
    within = Window.partitionBy(PART, *by).orderBy(*order).rowsBetween(before, -1)
    inner = rows.withColumns(
        {f"_in_{n}": F.coalesce(F.sum(v).over(within), zero) for n, v in values.items()}
    )
    same = [F.col(PART) == F.col("_part")] + [F.col(b).eqNullSafe(F.col(f"_by_{b}")) for b in by]
    return (
        inner.join(offsets, same)
        .withColumns({n: F.col(f"_in_{n}") + F.col(f"_{n}") for n in values})
        .drop("_part", *[f"_by_{b}" for b in by], *[f"{p}{n}" for n in values for p in ("_in_", "_")])
    )
