"""Inspection of the result table: latest rows, lookups, audit trails, copies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaymill.functions import audit

# --- Fixed values: the columns that each inspection query shows -------------------------
SUMMARY = (
    "id",
    "flow_id",
    "item_id",
    "counter_value",
    "metric_value",
    "examined_status",
    "verified_by",
    "created_at",
)
COMPARED = ("id", "message_id", "flow_id", "item_id", "counter_value", "metric_value")
_DETAIL = {
    1: ("message_id", "initial_data", "counter_value"),
    2: ("message_id", "initial_data", "metric_value", "examined_status", "verified_by"),
}
# --------------------------------------------------------------------------------------


def latest(rows: DataFrame, n: int = 10, columns: tuple[str, ...] = SUMMARY) -> DataFrame:
    """The n newest rows, newest first. Each task keeps n rows; nothing is fully sorted."""
    return _newest(rows, n, columns)


def _newest(rows: DataFrame, n: int, columns: tuple[str, ...]) -> DataFrame:
    place = [c for c in ("id", "position", "flow_id") if c in rows.columns]
    wanted = rows.select(*columns, *(c for c in place if c not in columns))
    return wanted.orderBy(*(F.col(c).desc() for c in place)).limit(n).select(*columns)


def detail(rows: DataFrame, flow: int) -> DataFrame:
    """The columns shown for rows of a flow, with the audit trail as indented JSON."""
    return rows.where(F.col("flow_id") == flow).select(
        *_DETAIL[flow], audit.pretty(F.col("history_trail")).alias("audit_trail")
    )


def latest_of_flow(rows: DataFrame, flow: int) -> DataFrame:
    """Detail of the newest row of a flow. The trail is rendered for that row only."""
    columns = ("id", "flow_id", *_DETAIL[flow], "history_trail")
    newest = rows.where(F.col("flow_id") == flow)
    return detail(_newest(newest, 1, columns), flow)


def by_message(rows: DataFrame, message_id: str | Column) -> DataFrame:
    return rows.where(F.col("message_id") == message_id)


def by_flow_item(rows: DataFrame, flow: int, item_id: int) -> DataFrame:
    return rows.where((F.col("flow_id") == flow) & (F.col("item_id") == item_id))


def created_between(rows: DataFrame, start: str | Column, end: str | Column) -> DataFrame:
    """Rows with start <= created_at < end."""
    low = F.lit(start).cast("timestamp")
    high = F.lit(end).cast("timestamp")
    return rows.where((F.col("created_at") >= low) & (F.col("created_at") < high))


def audit_steps(rows: DataFrame) -> DataFrame:
    """One row per audit entry, in order, with the line shown for it."""
    steps = rows.select(
        "id", "message_id", F.posexplode("history_trail").alias("_pos", "_step")
    )
    step = F.col("_step")
    absent = F.lit("None")
    described = audit.description(step)
    line = F.concat(
        F.lit("["),
        F.coalesce(step["stage"], absent),
        F.lit("] at "),
        F.coalesce(step["timestamp"], absent),
        F.lit(": "),
        F.coalesce(described, absent),
    )
    return steps.select(
        "id",
        "message_id",
        (F.col("_pos") + 1).alias("step"),
        step["stage"].alias("stage"),
        step["timestamp"].alias("timestamp"),
        described.alias("description"),
        line.alias("line"),
    )


def audit_step_counts(rows: DataFrame) -> DataFrame:
    return rows.select(
        "id", "message_id", audit.step_count(F.col("history_trail")).alias("steps")
    )


def compare_copies(
    copies: dict[str, DataFrame], columns: tuple[str, ...] = COMPARED
) -> DataFrame:
    """Rows that do not occur equally often in every copy, with their count per copy.

    An empty result means the copies are identical. All copies are compared in one
    shuffle; rows are counted before it, so repeated rows do not gather anywhere.
    """
    tagged = reduce(
        DataFrame.unionByName,
        [
            rows.select(
                *columns, *[F.lit(int(name == other)).alias(f"_in_{other}") for other in copies]
            )
            for name, rows in copies.items()
        ],
    )
    counted = tagged.groupBy(*columns).agg(
        *[F.sum(f"_in_{name}").alias(f"in_{name}") for name in copies]
    )
    counts = [F.col(f"in_{name}") for name in copies]
    return counted.where(F.least(*counts) != F.greatest(*counts))


def compare_latest(
    copies: dict[str, DataFrame], n: int = 5, columns: tuple[str, ...] = COMPARED
) -> DataFrame:
    """The same comparison on the n newest rows of each copy."""
    return compare_copies({k: latest(v, n, columns) for k, v in copies.items()}, columns)
