"""Record layouts, the queue registry and the routing map."""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values: queue names, flow numbers, constant texts -------------------------
FLOW1_P1_TO_P2 = "flow1_p1_to_p2"
FLOW1_P2_TO_P3 = "flow1_p2_to_p3"
FLOW1_P3_TO_P4 = "flow1_p3_to_p4"
FLOW2_P1_TO_P2 = "flow2_p1_to_p2"
FLOW2_P2_TO_P3 = "flow2_p2_to_p3"
FLOW2_P3_REFLECTED = "flow2_p3_reflected"

PATH_FLOW1 = "/api/flow1"
PATH_FLOW2 = "/api/flow2"
PATH_BATCH = "/api/batch"

HIGH = "HIGH"
NORMAL = "NORMAL"
VERIFIER = "process3"
THRESHOLD = 30.0
SCALE = 1.15
COUNTER_STEP = 10
COUNTER_BASE = 100
DEFAULT_BATCH_COUNT = 3
# --------------------------------------------------------------------------------------

# flow -> the queues a message of that flow passes, in order (into stage 2, 3 and 4).
ROUTES = {
    1: (FLOW1_P1_TO_P2, FLOW1_P2_TO_P3, FLOW1_P3_TO_P4),
    2: (FLOW2_P1_TO_P2, FLOW2_P2_TO_P3, FLOW2_P3_REFLECTED),
}
QUEUES = tuple(queue for queues in ROUTES.values() for queue in queues)
# queue -> (flow, stage) of the handler that consumes it. The queue decides, not the
# message's own "flow" key.
HANDLERS = {
    queue: (flow, hop + 2)
    for flow, queues in ROUTES.items()
    for hop, queue in enumerate(queues)
}
LAST_STAGE = 4


def handler_of(queue: str) -> tuple[int, int]:
    """(flow, stage) served by a queue; an undeclared queue is an error."""
    if queue not in HANDLERS:
        raise ValueError(f"unknown queue {queue!r}; known: {', '.join(QUEUES)}")
    return HANDLERS[queue]


def next_queue(queue: str) -> str | None:
    """Queue the handler of ``queue`` publishes to, None after the last stage."""
    flow, stage = handler_of(queue)
    return ROUTES[flow][stage - 1] if stage < LAST_STAGE else None


# What a client sent. ``seq`` is the arrival number of the request.
REQUEST = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("path", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("received_at", T.TimestampType()),
    ]
)

# What lies in a queue: the JSON document plus its place in the order of arrival and the
# clock reading its next stage stamps it with. The place is the request's arrival number
# and, for the messages of a batch, the position in it (0 for a single message).
QUEUE_RECORD = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("position", T.LongType()),
        T.StructField("clock", T.TimestampType()),
        T.StructField("body", T.StringType()),
    ]
)

# Keys an audit entry may hold, in the order they are written.
AUDIT_KEYS = (
    "stage",
    "timestamp",
    "status",
    "source",
    "status_assigned",
    "modification",
    "database_action",
)
# ``other`` holds the JSON text of an entry that is not an object of those keys with text
# values; queues accept any entry, so the typed form must be able to carry it.
AUDIT_ENTRY = T.StructType(
    [T.StructField(key, T.StringType()) for key in (*AUDIT_KEYS, "other")]
)
HISTORY = T.ArrayType(AUDIT_ENTRY)

# Keys without a column in the table; they are kept in the stored document only.
UNSTORED_FLAGS = ("process2_flow1_reflected", "process3_acknowledged", "completed")
# Message keys the sink stores in a column of its own.
STORED_KEYS = (
    "message_id",
    "flow",
    "item_id",
    "initial_data",
    "counter",
    "value",
    "examined_status",
    "verified_by",
)

# A message between stages. A typed column that is not NULL is the value of its key; for
# a NULL column the value, if any, is what was read from the queue: ``read_<key>``, and
# ``verbatim``, the whole document, where ``keys`` has others than those (``keys`` is NULL for a
# message built here). ``counter_real`` stands in
# for ``counter`` when the number is not a 64-bit integer. ``history`` holds the entries
# added since the message was read, ``past`` the JSON text of those read with it.
MESSAGE = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("position", T.LongType()),
        T.StructField("clock", T.TimestampType()),
        T.StructField("flow", T.IntegerType()),
        T.StructField("message_id", T.StringType()),
        T.StructField("item_id", T.LongType()),
        T.StructField("initial_data", T.StringType()),
        T.StructField("counter", T.LongType()),
        T.StructField("counter_real", T.DoubleType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("past", T.StringType()),
        T.StructField("history", HISTORY),
        T.StructField("process2_flow1_reflected", T.BooleanType()),
        T.StructField("process3_acknowledged", T.BooleanType()),
        T.StructField("examined_status", T.StringType()),
        T.StructField("verified_by", T.StringType()),
        T.StructField("completed", T.BooleanType()),
        T.StructField("verbatim", T.VariantType()),
        T.StructField("keys", T.ArrayType(T.StringType())),
        *[T.StructField(f"read_{key}", T.VariantType()) for key in (*STORED_KEYS, *UNSTORED_FLAGS)],
        T.StructField("reject_stage", T.IntegerType()),
        T.StructField("reject_reason", T.StringType()),
    ]
)

INT_MIN, INT_MAX = -(2**31), 2**31 - 1
TEXT_LIMITS = {
    "message_id": 64,
    "initial_data": 255,
    "examined_status": 50,
    "verified_by": 50,
}

# The columns of the result table, but for `position`. Rows are in the order of (id, position): the place in which the first
# delivery of the key arrived.
PROCESSED = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("position", T.LongType(), False),
        T.StructField("message_id", T.StringType(), False),
        T.StructField("flow_id", T.IntegerType(), False),
        T.StructField("item_id", T.IntegerType(), False),
        T.StructField("initial_data", T.StringType()),
        T.StructField("counter_value", T.IntegerType()),
        T.StructField("metric_value", T.DecimalType(10, 2)),
        T.StructField("examined_status", T.StringType()),
        T.StructField("verified_by", T.StringType()),
        T.StructField("history_trail", HISTORY, False),
        T.StructField("raw_payload", T.StringType(), False),
        T.StructField("created_at", T.TimestampType()),
    ]
)
# On a repeated message_id the first delivery decides KEPT, the last one OVERWRITTEN.
KEPT = ("flow_id", "item_id", "initial_data", "created_at")
OVERWRITTEN = (
    "counter_value",
    "metric_value",
    "examined_status",
    "verified_by",
    "history_trail",
    "raw_payload",
)
