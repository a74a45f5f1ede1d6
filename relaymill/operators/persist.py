"""Stage 4: message to table row, the table's constraints, and the upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaymill.functions import audit, json_values as J
from relaymill.operators.messages import reject, with_document
from relaymill.schema import INT_MAX, INT_MIN, KEPT, OVERWRITTEN, PROCESSED, TEXT_LIMITS

# column -> message key it is fed from
_SOURCES = {
    "message_id": "message_id",
    "flow_id": "flow",
    "item_id": "item_id",
    "initial_data": "initial_data",
    "counter_value": "counter",
    "metric_value": "value",
    "examined_status": "examined_status",
    "verified_by": "verified_by",
}
_REQUIRED = ("message_id", "flow", "item_id")
# Fixed value: what the table's number columns take as text. A plain cast would also take
# suffixes and hexadecimal forms.
_DECIMAL_TEXT = r"^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"


def _text(key: str) -> Column:
    """Text of a scalar, NULL for a list or object (and for null)."""
    read = F.col(f"read_{key}")
    kind = J.kind(read)
    scalar = (
        F.when(kind == "BOOLEAN", J.as_bigint(read).cast("string"))
        .when(~J.is_composite(kind), F.try_variant_get(read, "$", "string"))
    )
    return F.coalesce(F.col(key), scalar)


def _number(key: str) -> Column:
    """DOUBLE of a number or numeric text, NULL otherwise."""
    read = F.col(f"read_{key}")
    kind = J.kind(read)
    text = F.trim(F.try_variant_get(read, "$", "string"))
    return F.when(
        kind == "STRING", F.when(text.rlike(_DECIMAL_TEXT), text.try_cast("double"))
    ).when(J.is_number(kind), J.as_double(read))


def _whole(key: str, typed: Column) -> Column:
    """BIGINT of a stored integer; fractions round half away from zero."""
    return F.coalesce(typed.cast("bigint"), F.round(_number(key)).try_cast("bigint"))


def to_rows(messages: DataFrame, created_at: Column | None = None) -> DataFrame:
    """Messages as rows of the result table plus ``seq``, the table's rules checked.

    Absent keys become NULL. A row the table would refuse is marked with the first rule
    it breaks; a redelivery that is refused must not touch the stored row, so rejected
    rows are to be left out before ``upsert``. ``raw_payload`` is computed only when a
    later step asks for it.
    """
    created = F.current_timestamp() if created_at is None else created_at
    cells = {
        "message_id": _text("message_id"),
        "flow": _whole("flow", F.col("flow")),
        "item_id": _whole("item_id", F.col("item_id")),
        "initial_data": _text("initial_data"),
        "counter": F.coalesce(
            F.col("counter"),
            F.round("counter_real").try_cast("bigint"),
            _whole("counter", F.lit(None)),
        ),
        "value": F.coalesce(F.col("value"), _number("value")).try_cast("decimal(10,2)"),
        "examined_status": _text("examined_status"),
        "verified_by": _text("verified_by"),
    }
    typed = messages.withColumns({f"_{key}": cell for key, cell in cells.items()})

    rules: list[tuple[Column, str]] = []
    for key in cells:
        cell = F.col(f"_{key}")
        given = F.col(key).isNotNull() | J.is_present(F.col(f"read_{key}"))
        if key == "counter":
            given = given | F.col("counter_real").isNotNull()
        if key in _REQUIRED:
            rules.append((~given, f"{key}_missing"))
        rules.append((given & cell.isNull(), f"{key}_unusable"))
        if key in TEXT_LIMITS:
            rules.append((F.length(cell) > TEXT_LIMITS[key], f"{key}_too_long"))
        elif key != "value":
            rules.append((~cell.between(INT_MIN, INT_MAX), f"{key}_out_of_range"))
    # the document takes the entries read as text, the table takes them typed
    checked = audit.with_full_trail(with_document(reject(typed, 4, *rules), "raw_payload"))

    layout = {f.name: f.dataType for f in PROCESSED.fields}
    columns = [
        F.col(f"_{key}").try_cast(layout[name]).alias(name) for name, key in _SOURCES.items()
    ]
    kept_aside = ["body"] if "body" in messages.columns else []
    return checked.select(
        "seq",
        F.coalesce("position", F.lit(0).cast("bigint")).alias("position"),
        *columns,
        F.col("history").alias("history_trail"),
        "raw_payload",
        created.cast("timestamp").alias("created_at"),
        "reject_stage",
        "reject_reason",
        *kept_aside,
    )


def arrival(rows: DataFrame) -> Column:
    """The place of a delivery in the order of arrival, as a struct that compares.

    First the place of the request it comes from; then, where the same message is delivered
    again under the same place, the batch in which it reached the sink (``batch_id``, where
    the rows carry it); at last its content, so that the result never depends on the order
    of rows.
    """
    def given(name: str) -> Column:
        found = F.col(name) if name in rows.columns else F.lit(None)
        return F.coalesce(found.cast("bigint"), F.lit(0).cast("bigint")).alias(name)

    content = [c for c in (*KEPT, *OVERWRITTEN) if c in rows.columns]
    return F.struct("seq", given("position"), given("batch_id"), F.xxhash64(*content).alias("content"))


def upsert_state(rows: DataFrame, collation: str | None = None) -> DataFrame:
    """Per message id: the first delivery's kept columns and the last one's others.

    Deliveries are ordered by ``arrival``. NULLs of the last delivery overwrite, hence whole
    structs rather than single columns. The partial aggregation before the shuffle leaves at
    most one row per id and task, so an id with very many deliveries costs no more than any
    other. Only columns present in ``rows`` take part: select fewer of them to move less.

    ``collation`` compares ids as that collation does instead of byte by byte.
    """
    kept = [c for c in KEPT if c in rows.columns]
    overwritten = [c for c in OVERWRITTEN if c in rows.columns]
    placed = rows.withColumn("at", arrival(rows))
    return placed.groupBy(_key(collation).alias("_key")).agg(
        F.min_by(F.struct("at", "message_id", *kept), "at").alias("first"),
        F.max_by(F.struct("at", *overwritten), "at").alias("last"),
    )


def normal_key(message_id: Column, collation: str | None) -> Column:
    """A text that is equal for ids which are equal under the collation.

    Plain text can be a key of state and of buckets, which Spark refuses to collated text.
    """
    if collation is None:
        return message_id
    rules = set(collation.upper().split("_"))
    if "AI" in rules:
        raise ValueError(f"{collation} compares without accents, which no function of Spark removes")
    key = F.rtrim(message_id) if "RTRIM" in rules else message_id
    return F.lower(F.upper(key)) if rules & {"CI", "LCASE"} else key


def _key(collation: str | None) -> Column:
    return normal_key(F.col("message_id"), collation)


def merge_states(states: DataFrame) -> DataFrame:
    """Combine upsert states of the same keys, e.g. a stored snapshot and new deliveries."""
    return states.groupBy("_key").agg(
        F.min_by("first", F.col("first.at")).alias("first"),
        F.max_by("last", F.col("last.at")).alias("last"),
    )


def table_rows(states: DataFrame, with_places: bool = False) -> DataFrame:
    """Rows of the result table; ``id`` and ``position`` are the place of the first delivery.

    ``first_at`` and ``last_at``, the places of both deliveries, are what a later merge needs.
    """
    first = [c for c in states.schema["first"].dataType.names if c != "at"]
    last = [c for c in states.schema["last"].dataType.names if c != "at"]
    cells = {"id": F.col("first.at.seq"), "position": F.col("first.at.position")}
    cells |= {c: F.col(f"first.{c}") for c in first} | {c: F.col(f"last.{c}") for c in last}
    columns = [cells[name].alias(name) for name in PROCESSED.names if name in cells]
    if with_places:
        columns += [F.col("first.at").alias("first_at"), F.col("last.at").alias("last_at")]
    return states.select(*columns)


def states_of(rows: DataFrame, collation: str | None = None) -> DataFrame:
    """Table rows with their places as upsert states, for merging with new deliveries."""
    return rows.select(
        _key(collation).alias("_key"),
        F.struct(F.col("first_at").alias("at"), "message_id", *KEPT).alias("first"),
        F.struct(F.col("last_at").alias("at"), *OVERWRITTEN).alias("last"),
    )


def upsert(rows: DataFrame, collation: str | None = None) -> DataFrame:
    """Result table of accepted deliveries."""
    return table_rows(upsert_state(rows, collation))
