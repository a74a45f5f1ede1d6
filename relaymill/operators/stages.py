"""Stages 2 to 4: adjust, classify, scale, acknowledge, seal and record messages.

Every stage maps message columns to message columns with narrow expressions, so chained
stages run in one Spark stage.

``clock`` is the reading a stage stamps its audit entry with: any column, so results can
be reproduced; the current time unless given. ``where`` limits a stage to the messages it
is meant for and leaves all others as they are, so that one pass can serve both flows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaymill.functions import audit, json_values as J
from relaymill.functions.rounding import round_cents
from relaymill.operators.messages import reject
from relaymill.schema import COUNTER_STEP, HIGH, NORMAL, SCALE, THRESHOLD, VERIFIER

Stage = Callable[[DataFrame, Column | None, Column | None], DataFrame]


def _assign(messages: DataFrame, where: Column | None, **changes: Column) -> DataFrame:
    if where is not None:
        changes = {
            name: F.when(where, new).otherwise(F.col(name)) for name, new in changes.items()
        }
    return messages.withColumns(changes)


def _reject(
    messages: DataFrame, stage: int, where: Column | None, *rules: tuple[Column, str]
) -> DataFrame:
    """The stage's own rules, then: history must be a list, whatever its elements."""
    rules = (*rules, (F.col("history").isNull(), "history_not_a_list"))
    if where is not None:
        rules = tuple((where & condition, reason) for condition, reason in rules)
    return reject(messages, stage, *rules)


def _stamped(constants: dict[str, str], clock: Column | None, **computed: Column) -> Column:
    """The trail with this stage's entry at its end."""
    reading = F.current_timestamp() if clock is None else clock
    return audit.appended(F.col("history"), audit.entry(constants, reading, **computed))


def _not_number(key: str) -> tuple[Column, str]:
    """The key is there but holds null, text, a list or an object."""
    value = F.col(f"read_{key}")
    bad = value.isNotNull() & ~J.is_number(J.kind(value))
    return bad, f"{key}_not_a_number"


def reflect_counter(
    messages: DataFrame, clock: Column | None = None, where: Column | None = None
) -> DataFrame:
    """Flow 1, stage 2: counter + 10 (0 when absent), flag, audit entry."""
    read = F.col("read_counter")
    # What a previous stage left in the typed columns, else what was received. A number
    # that is no 64-bit integer continues in counter_real.
    received = messages.withColumns(
        {
            "_whole": F.when(read.isNull(), F.lit(0).cast("bigint")).otherwise(J.as_bigint(read)),
            "_real": F.coalesce("counter_real", J.as_double(read)),
        }
    )
    integral = F.col("counter_real").isNull() & (
        F.col("_real").isNull() | (F.col("_whole").cast("double") == F.col("_real"))
    )
    stepped = received.withColumn(
        "_whole",
        F.try_add(
            F.coalesce("counter", F.when(integral, F.col("_whole"))),
            F.lit(COUNTER_STEP).cast("bigint"),
        ),
    )
    reflected = _assign(
        stepped,
        where,
        counter=F.col("_whole"),
        counter_real=F.when(
            F.col("_whole").isNull(),
            F.coalesce(F.col("_real"), F.col("counter").cast("double")) + COUNTER_STEP,
        ),
        process2_flow1_reflected=F.lit(True),
        history=_stamped(audit.REFLECTED, clock),
    ).drop("_whole", "_real")
    return _reject(reflected, 2, where, _not_number("counter"))


def examine_value(
    messages: DataFrame, clock: Column | None = None, where: Column | None = None
) -> DataFrame:
    """Flow 2, stage 2: HIGH above the threshold, then value scaled and rounded."""
    read = F.col("read_value")
    received = messages.withColumn(
        "_raw",
        F.coalesce(
            F.col("value"), F.when(read.isNull(), F.lit(0.0)).otherwise(J.as_double(read))
        ),
    )
    raw = F.col("_raw")
    # NaN compares as the largest number in Spark; a comparison with it must fail.
    status = F.when((raw > THRESHOLD) & ~F.isnan(raw), F.lit(HIGH)).otherwise(F.lit(NORMAL))
    classified = received.withColumns({"_status": status, "_scaled": raw * F.lit(SCALE)})
    # Rounded in a column of its own: outside any condition its parts are shared.
    rounded = classified.withColumn("_scaled", round_cents(F.col("_scaled")))
    examined = _assign(
        rounded,
        where,
        value=F.col("_scaled"),
        examined_status=F.col("_status"),
        history=_stamped(audit.EXAMINED, clock, status_assigned=F.col("_status")),
    ).drop("_raw", "_status", "_scaled")
    return _reject(examined, 2, where, _not_number("value"))


def acknowledge(
    messages: DataFrame, clock: Column | None = None, where: Column | None = None
) -> DataFrame:
    """Flow 1, stage 3: mark as acknowledged."""
    marked = _assign(
        messages,
        where,
        process3_acknowledged=F.lit(True),
        history=_stamped(audit.FORWARDED, clock),
    )
    return _reject(marked, 3, where)


def seal(
    messages: DataFrame, clock: Column | None = None, where: Column | None = None
) -> DataFrame:
    """Flow 2, stage 3: add the verifier and mark as completed."""
    marked = _assign(
        messages,
        where,
        verified_by=F.lit(VERIFIER),
        completed=F.lit(True),
        history=_stamped(audit.SEALED, clock),
    )
    return _reject(marked, 3, where)


def record_save(
    messages: DataFrame, clock: Column | None = None, where: Column | None = None
) -> DataFrame:
    """Both flows, stage 4: the audit entry written with the row."""
    return _reject(_assign(messages, where, history=_stamped(audit.SAVED, clock)), 4, where)


# (flow, stage) -> what its handler does
STAGES: dict[tuple[int, int], Stage] = {
    (1, 2): reflect_counter,
    (2, 2): examine_value,
    (1, 3): acknowledge,
    (2, 3): seal,
    (1, 4): record_save,
    (2, 4): record_save,
}
