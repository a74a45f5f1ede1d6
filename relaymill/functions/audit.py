"""The audit trail: an ordered array of entries carried inside every message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaymill.functions.json_values import cut_bytes
from relaymill.schema import AUDIT_KEYS

# --- Fixed values: the entry each stage writes (keys besides the timestamp) -----------
CREATED = {"stage": "process1_created", "status": "prepared", "source": "rest_api"}
REFLECTED = {
    "stage": "process2_reflected",
    "modification": "Added +10 to counter and flagged reflected",
}
EXAMINED = {
    "stage": "process2_examined_and_forwarded",
    "modification": "Applied 15% scaling factor and assigned status",
}
FORWARDED = {
    "stage": "process3_received_and_forwarded",
    "status": "forwarded_to_process4",
}
SEALED = {
    "stage": "process3_reflected",
    "modification": "Added verification seal and marked completed",
}
SAVED = {
    "stage": "process4_saved_to_mariadb",
    "database_action": "INSERT/UPDATE processed_messages",
}
# --------------------------------------------------------------------------------------


def clock_text(clock: Column) -> Column:
    """Wall-clock text in whole seconds, in the session time zone."""
    return F.date_format(clock.cast("timestamp"), "yyyy-MM-dd HH:mm:ss")


def entry(constants: dict[str, str], clock: Column, **computed: Column) -> Column:
    """One audit entry; keys that are not given stay NULL and are never written."""
    values = {key: F.lit(text) for key, text in constants.items()} | computed
    values["timestamp"] = clock_text(clock)
    missing = F.lit(None).cast("string")
    return F.struct(
        *[values.get(key, missing).alias(key) for key in AUDIT_KEYS], missing.alias("other")
    )


def started(clock: Column) -> Column:
    """A new trail with its first entry."""
    return F.array(entry(CREATED, clock))


def appended(history: Column, entry_: Column) -> Column:
    return F.array_append(history, entry_)


# A trail as stages write it: objects of texts in which nothing is escaped or would be (as characters
# beyond 16 bits are), without blanks between. The quantifiers give nothing back, so a trail of any
# length takes no stack. Commas need no care: the document is known to be JSON.
_TEXT = r'"[^"\\\x00-\x1f\x{10000}-\x{10ffff}]*+"'
_AS_WRITTEN = rf'"history":(\[(?:\{{(?:{_TEXT}:{_TEXT},?)++\}},?)++\])'


def _once(body: Column) -> Column:
    """The key is in the text once, and none can be hidden behind an escape."""
    return ~body.contains("\\u") & (F.regexp_count(body, F.lit('"history"')) == 1)


def as_written(body: Column) -> Column:
    """The text of a history that stands in the document as it would be written again, at whatever
    depth it is; else empty or NULL."""
    return F.when(_once(body), F.regexp_extract(body, _AS_WRITTEN, 1))


def past_text(body: Column, value: Column, keys: Column, found: Column) -> Column:
    """JSON text of a history read from a queue, NULL when it is no array.

    ``found`` is what ``as_written`` finds, which is the history if that is among the ``keys`` of the
    document. ``value`` is the history as a VARIANT. Writing that as JSON is slow, so the text is
    taken out of the document where this is sure to be the same: the key is there once,
    an array follows it, and no key can be hidden behind an escape.
    """
    plain = body.rlike(r'"history"\s*:\s*\[') & _once(body)
    taken = F.get_json_object(body, "$.history")
    written = F.to_json(value)
    return (
        F.when((F.octet_length(found) > 0) & F.array_contains(keys, "history"), found)
        .when(plain, taken)
        .otherwise(F.when(written.startswith("["), written))
    )


def document_text(past: Column, history: Column) -> Column:
    """JSON text of the entries read (may be NULL) followed by those added since."""
    added = F.to_json(history)
    comma = F.when((past == "[]") | (added == "[]"), F.lit("")).otherwise(F.lit(","))
    spliced = F.concat(
        cut_bytes(past, last=1),
        comma,
        cut_bytes(added, first=1),
    )
    return F.when(past.isNull(), added).otherwise(spliced)


def with_full_trail(rows: DataFrame) -> DataFrame:
    """Turn ``past`` and ``history`` into the whole typed trail in ``history``.

    The text is read into typed entries, and taken as it is when writing it back gives
    the same text, i.e. when nothing was lost. Otherwise each entry is tested by itself
    and one that does not fit keeps its JSON text in ``other``.
    """
    # keys in the order in which a parsed document writes them
    layout = ", ".join(f"{key}: string" for key in sorted(AUDIT_KEYS))
    nothing = F.lit(None).cast("string")
    past, typed = F.col("past"), F.col("_typed")

    def laid_out(e: Column) -> Column:
        return F.struct(*[e[k].alias(k) for k in AUDIT_KEYS], nothing.alias("other"))

    def one(e: Column) -> Column:
        read = F.try_variant_get(e, "$", f"struct<{layout}>")
        other = F.struct(*[nothing.alias(k) for k in AUDIT_KEYS], F.to_json(e).alias("other"))
        fits = F.coalesce(F.to_json(read) == F.to_json(e), F.lit(False))
        return F.when(fits, laid_out(read)).otherwise(other)

    each = F.transform(F.try_variant_get(F.try_parse_json(past), "$", "array<variant>"), one)
    # Entries as the stages write them come back as the same text in the written order.
    straight = F.from_json(past, f"array<struct<{', '.join(f'{k}: string' for k in AUDIT_KEYS)}>>")
    entries = F.when(F.to_json(typed) == past, F.transform(typed, laid_out)).otherwise(each)
    return (
        rows.withColumn("_typed", straight)
        .withColumn(
            "history",
            F.when(past.isNull(), F.col("history")).otherwise(F.concat(entries, F.col("history"))),
        )
        .drop("_typed")
    )


def to_json(history: Column) -> Column:
    """JSON text of a stored trail; absent keys stay absent."""
    pieces = F.transform(history, lambda e: F.coalesce(e["other"], F.to_json(e)))
    mixed = F.concat(F.lit("["), F.array_join(pieces, ","), F.lit("]"))
    return F.when(F.exists(history, lambda e: e["other"].isNotNull()), mixed).otherwise(
        F.to_json(history)
    )


def pretty(history: Column) -> Column:
    """Indented JSON text of a trail, for reading."""
    indented = {"pretty": "true"}
    pieces = F.transform(history, lambda e: F.coalesce(e["other"], F.to_json(e, indented)))
    mixed = F.concat(F.lit("[ "), F.array_join(pieces, ", "), F.lit(" ]"))
    return F.when(F.exists(history, lambda e: e["other"].isNotNull()), mixed).otherwise(
        F.to_json(history, indented)
    )


def step_count(history: Column) -> Column:
    """Number of entries, 0 without a trail."""
    return F.when(history.isNull(), F.lit(0)).otherwise(F.size(history))


def description(step: Column) -> Column:
    """First of modification, status, action that is neither absent nor empty; when the
    first two are, the action as it is."""
    return F.coalesce(
        F.nullif(step["modification"], F.lit("")),
        F.nullif(step["status"], F.lit("")),
        step["database_action"],
    )
