"""Whole flows: handlers chained on message columns or on queue records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaymill.operators import messages as M, persist
from relaymill.operators.stages import STAGES
from relaymill.schema import LAST_STAGE, ROUTES, handler_of


def handle(records: DataFrame, queue: str, clock: Column | None = None) -> DataFrame:
    """What the handler of a queue makes of its records: message columns, rejects marked."""
    flow, stage = handler_of(queue)
    return STAGES[flow, stage](M.decode(records, stage), clock)


def forward(
    records: DataFrame, queue: str, clock: Column | None = None, in_order: bool = False
) -> DataFrame:
    """The same as records for the next queue (one hop of a flow). ``in_order`` keeps the
    order and spelling of the documents."""
    return M.encode(handle(records, queue, clock), in_order)


def advance(
    messages: DataFrame,
    flow: int | None = None,
    clock: Column | None = None,
    first: int = 2,
    last: int = LAST_STAGE,
) -> DataFrame:
    """Messages through stages ``first`` to ``last``, without queues between.

    Everything is a narrow expression on the same row, so Spark fuses it into one stage;
    documents are neither written nor parsed on the way. Without ``flow`` the messages
    are of both flows as their ``flow`` column says, and still make a single pass.
    """
    for stage in range(first, last + 1):
        if flow is not None:
            messages = STAGES[flow, stage](messages, clock)
        elif STAGES[1, stage] is STAGES[2, stage]:
            messages = STAGES[1, stage](messages, clock)
        else:
            for each in ROUTES:
                messages = STAGES[each, stage](messages, clock, F.col("flow") == each)
    return messages


def finish(
    messages: DataFrame, flow: int | None = None, clock: Column | None = None, first: int = 2
) -> DataFrame:
    """Messages as checked rows of the result table, not yet upserted."""
    return persist.to_rows(advance(messages, flow, clock, first), clock)


def finish_records(records: DataFrame, queue: str, clock: Column | None = None) -> DataFrame:
    """Queue records as checked table rows, through all stages from that queue on."""
    flow, stage = handler_of(queue)
    return finish(M.decode(records, stage), flow, clock, first=stage)
