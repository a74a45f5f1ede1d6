"""Moving between queue records (JSON documents) and message columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaymill.functions import audit, json_values as J, splice
from relaymill.schema import HISTORY, MESSAGE, STORED_KEYS, UNSTORED_FLAGS

_BASE = ("flow", "message_id", "item_id", "initial_data", "counter")
_FLAGS = (
    "process2_flow1_reflected",
    "process3_acknowledged",
    "examined_status",
    "verified_by",
    "completed",
)
_KNOWN = (*STORED_KEYS, *UNSTORED_FLAGS)
_HANDLED = (*_KNOWN, "history")
# Numbers that are not finite are written as these bare words, which are not JSON. The key
# and the column that takes such a number when it is read.
_NOT_FINITE = {
    key: (rf'(?<!\\)("{key}"\s*:\s*)(-?Infinity|NaN)(?=\s*[,}}])', column)
    for key, column in (("value", "value"), ("counter", "counter_real"))
}
# A text of more characters is beyond the parser (its own limit), as is one nested deeper than 1,000.
LONGEST_DOCUMENT = 20_000_000


def with_missing_columns(messages: DataFrame) -> DataFrame:
    """Message columns in schema order, absent ones as typed NULLs, then any others."""
    present = set(messages.columns)
    laid_out = [
        F.col(f.name) if f.name in present else F.lit(None).cast(f.dataType).alias(f.name)
        for f in MESSAGE.fields
    ]
    others = [c for c in messages.columns if c not in MESSAGE.names]
    return messages.select(*laid_out, *others)


def reject(messages: DataFrame, stage: int, *rules: tuple[Column, str]) -> DataFrame:
    """Mark messages for which a rule holds, first rule wins; earlier marks stay."""
    verdict = F.lit(None).cast("string")
    for condition, reason in reversed(rules):
        verdict = F.when(condition, F.lit(reason)).otherwise(verdict)
    marked = messages.withColumn("reject_reason", F.coalesce("reject_reason", verdict))
    return marked.withColumn(
        "reject_stage",
        F.coalesce(
            "reject_stage", F.when(F.col("reject_reason").isNotNull(), F.lit(stage))
        ),
    )


def only(rows: DataFrame, condition: Column) -> DataFrame:
    """Rows for which ``condition`` holds, tested after their columns are computed.

    A plain filter on a computed column is pushed down to the scan with the computation
    copied into it, so that every document would be parsed again for the test, once per
    mention. Exploding a one-element array per kept row filters where it stands.
    """
    mark = F.explode(F.when(condition, F.array(F.lit(True))))
    return rows.withColumn("_kept", mark).drop("_kept")


def accepted(messages: DataFrame) -> DataFrame:
    return only(messages, F.col("reject_reason").isNull())


def rejected(messages: DataFrame) -> DataFrame:
    """Messages set aside: where they failed, why, and the document as it was received."""
    return only(messages, F.col("reject_reason").isNotNull()).select(
        "seq", F.col("reject_stage").alias("stage"), F.col("reject_reason").alias("reason"), "body"
    )


def decode(records: DataFrame, stage: int) -> DataFrame:
    """Queue records (seq, clock, body, ...) as messages for the handler of ``stage``.

    A document that is not a JSON object is marked as rejected here. The document itself
    stays in ``body`` for the reject output. A metric or counter of NaN or Infinity, which
    a stage before may have written, is read back as that number.
    """
    if "position" not in records.columns:
        records = records.withColumn("position", F.lit(0).cast("bigint"))
    json, numbers = F.col("body"), {}
    for pattern, column in _NOT_FINITE.values():
        odd = F.col("body").rlike(pattern)
        json = F.when(odd, F.regexp_replace(json, pattern, "$1null")).otherwise(json)
        numbers[column] = F.when(odd, F.regexp_extract("body", pattern, 2).try_cast("double"))
    # one test for the rare case keeps the others cheap
    rare = F.col("body").contains("Infinity") | F.col("body").contains("NaN")
    records = records.withColumns(
        {"_json": F.when(rare, json).otherwise(F.col("body"))}
        | {column: F.when(rare, number) for column, number in numbers.items()}
    )
    parsed = J.with_json(records, "_json", "verbatim")
    document = F.col("verbatim")
    # all known keys in one walk over the object; asked for one by one, each would be a search
    parsed = parsed.withColumns(
        {
            "_read": J.object_fields(document, _KNOWN),
            "keys": J.object_keys(document),
            "_trail": audit.as_written(F.col("_json")),
        }
    )
    # the parsed document goes on only where it has keys that nobody knows, besides those read
    handled = F.array_contains("keys", "history").cast("int")
    for key in _KNOWN:
        handled = handled + F.col(f"_read.{key}").isNotNull().cast("int")
    opened = parsed.withColumns(
        {f"read_{key}": F.col(f"_read.{key}") for key in _KNOWN}
        | {
            f"read_{key}": F.when(F.col(column).isNull(), F.col(f"_read.{key}"))
            for key, (_, column) in _NOT_FINITE.items()
        }
        | {
            "past": audit.past_text(
                F.col("_json"), J.field(document, "history"), F.col("keys"), F.col("_trail")
            ),
            "_has_others": F.size("keys") > handled,
        }
    ).drop("_json", "_read", "_trail")
    started = opened.withColumns(
        {
            "history": F.when(F.col("past").isNotNull(), F.array().cast(HISTORY)),
            "verbatim": F.when(F.col("_has_others"), document),
            "_is_json": document.isNotNull(),
        }
    )
    not_json = ~F.col("_is_json")
    return reject(
        with_missing_columns(started),
        stage,
        (not_json & (F.octet_length("body") > LONGEST_DOCUMENT), "document_too_large"),
        (not_json, "not_json"),
        (~J.is_object_text(F.col("body")), "not_an_object"),
    ).drop("_is_json", "_has_others")


def with_document(messages: DataFrame, into: str) -> DataFrame:
    """Add the JSON document of a message: what its stages set, over what it was read with."""

    def real(name: str, key: str) -> Column:
        return F.concat(F.lit(f'"{key}":'), F.col(name).cast("string"))

    # Known keys no stage has set are written as they were read. Keys nobody knows are
    # carried over too; most documents have none, and then are not taken apart.
    def unset(key: str) -> Column:
        free = F.col(key).isNull()
        if key == "counter":
            free = free & F.col("counter_real").isNull()
        return F.when(free, F.col(f"read_{key}")).alias(key)

    others = F.map_filter(
        F.try_variant_get(F.col("verbatim"), J.ROOT, "map<string,variant>"),
        lambda key, _: ~key.isin(*_HANDLED),
    )
    was_read = F.col("keys").isNotNull()
    document = F.concat(
        F.lit("{"),
        F.concat_ws(
            ",",
            J.object_body(F.col("_base")),
            real("counter_real", "counter"),
            real("value", "value"),
            F.concat(
                F.lit('"history":'), audit.document_text(F.col("past"), F.col("history"))
            ),
            J.object_body(F.col("_flags")),
            J.object_body(F.col("_unset")),
            J.object_body(F.col("_others")),
        ),
        F.lit("}"),
    )
    return (
        messages.withColumns(
            {
                "_base": F.to_json(F.struct(*_BASE)),
                "_flags": F.to_json(F.struct(*_FLAGS)),
                "_unset": F.when(was_read, F.to_json(F.struct(*[unset(k) for k in _KNOWN]))),
                "_others": F.when(F.col("verbatim").isNotNull(), F.to_json(others)),
            }
        )
        .withColumn(into, document)
        .drop("_base", "_flags", "_unset", "_others")
    )


def with_document_in_order(messages: DataFrame, into: str) -> DataFrame:
    """Add the document a message was read with, changed in place by what its stage set.

    Members that the stage does not touch stay byte for byte, all stay in their order, and new
    ones follow behind. A document is written anew, as ``with_document`` does, where that is
    not sure to do: a touched name that is repeated or written with escapes, a flag that is there
    already, a number that is no bare word. Costs more than writing anew.
    """
    rows = with_document(messages, "_anew").withColumn("_pieces", splice.cut(F.col("body")))
    pieces, numbers = F.col("_pieces"), ("counter", "value")
    new = {
        "counter": F.coalesce(F.col("counter").cast("string"), F.col("counter_real").cast("string")),
        "value": F.col("value").cast("string"),
    }
    rows = rows.withColumns(
        {f"_at_{key}": splice.place_of(pieces, key) for key in (*numbers, "history")}
        | {f"_new_{key}": text for key, text in new.items()}
    )

    def has(key: str) -> Column:
        return F.array_contains("keys", key)

    def given(key: str) -> Column:
        return F.col(f"_new_{key}").isNotNull()

    def bare(key: str) -> Column:
        behind = F.element_at(pieces, F.col(f"_at_{key}") + 1)
        return F.coalesce(behind.rlike(r"^\s*:\s*[^\s,}\[{]"), F.lit(False))

    fits = F.col("_at_history").isNotNull() & ~F.col("body").rlike("[\x01\x02]")
    for key in numbers:
        fits = fits & (~given(key) | ~has(key) | bare(key))
    for key in _FLAGS:
        fits = fits & (F.col(key).isNull() | ~has(key))

    changed = pieces
    for key in numbers:
        scalar = splice.with_scalar(changed, F.col(f"_at_{key}"), F.col(f"_new_{key}"))
        rows = rows.withColumn(f"_with_{key}", F.when(given(key) & has(key), scalar).otherwise(changed))
        changed = F.col(f"_with_{key}")

    def behind(key: str) -> Column:
        return F.when(given(key) & ~has(key), F.concat(F.lit(f'"{key}":'), F.col(f"_new_{key}")))

    flags = J.object_body(F.to_json(F.struct(*_FLAGS)))
    added = F.concat_ws(",", behind("counter"), flags, behind("value"))
    rows = rows.withColumn("_with_members", splice.with_members(changed, F.nullif(added, F.lit(""))))
    changed = F.col("_with_members")
    rows = rows.withColumn("_end", splice.end_of_array(changed, F.col("_at_history")))
    entry = audit.to_json(F.col("history"))
    entry = F.substring(entry, F.lit(2), F.length(entry) - 2)
    extended = splice.with_element(changed, F.col("_end"), entry)
    spliced = splice.pasted(F.when(F.size("history") > 0, extended).otherwise(changed))
    helpers = [f"_{kind}_{key}" for key in numbers for kind in ("at", "new", "with")]
    return rows.withColumn(into, F.when(fits, spliced).otherwise(F.col("_anew"))).drop(
        "_anew", "_pieces", "_at_history", "_with_members", "_end", *helpers
    )


def encode(messages: DataFrame, in_order: bool = False, beside: tuple[str, ...] = ()) -> DataFrame:
    """Messages as queue records, rejects marked as such.

    ``body`` is the document for the next queue, or for a rejected message the document
    as it was received. ``in_order`` changes the received document in place, which keeps the
    order and the spelling of its members. ``beside`` names columns that stay beside the record.
    """
    document = F.col("_document")
    if "body" in messages.columns:
        document = F.when(F.col("reject_reason").isNull(), document).otherwise(F.col("body"))
    written = with_document_in_order if in_order and "body" in messages.columns else with_document
    return written(messages, "_document").select(
        "seq", "position", "clock", document.alias("body"), "reject_stage", "reject_reason", *beside
    )
