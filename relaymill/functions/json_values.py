"""JSON documents as VARIANT: strict parsing, and reading one value out of a document.

A key that is absent reads as SQL NULL; a key holding an explicit ``null`` reads as a
variant null. The two differ in meaning between stages, so nothing here merges them.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


_BLANKS = " \t\r\n"  # whitespace between JSON tokens

# Where the document is in the value that with_json makes.
ROOT = "$[0][0]"


def enclosed(text: Column) -> Column:
    """Text of one document as with_json encloses it."""
    return F.concat(F.lit("[["), text, F.lit("]]"))


# Raw control characters cannot occur in JSON, so these two may stand for what is escaped.
_ESCAPED = (("\\\\", "\x01"), ('\\"', "\x02"))
# Fixed value: the numbers that some writers put down as bare words. They are no keys.
_BARE_WORD = r"(?<![A-Za-z0-9_.+-])(-?Infinity|NaN)(?![A-Za-z0-9_.]|\s*:)"


def marked(text: Column) -> Column:
    """The text with marks for escaped backslashes and quotes: what quotes are left are those
    around strings."""
    for escaped, mark in _ESCAPED:
        text = F.replace(text, F.lit(escaped), F.lit(mark))
    return text


def unmarked(text: Column) -> Column:
    for escaped, mark in reversed(_ESCAPED):
        text = F.replace(text, F.lit(mark), F.lit(escaped))
    return text


def quoted_bare_words(text: Column) -> Column:
    """The text with bare NaN, Infinity and -Infinity, which JSON has not, as strings.

    What stands in strings stays: with escaped quotes out of the way, one pattern passes over
    whole strings and marks the words between them. Texts without such a word are not looked
    into. There is no function of arrays here, as these end the generated code.
    """
    found = F.regexp_replace(marked(text), rf'("[^"]*+")|{_BARE_WORD}', "$1\x03$2\x03")
    # behind a string both marks are left without a word
    quoted = F.replace(F.replace(found, F.lit("\x03\x03"), F.lit("")), F.lit("\x03"), F.lit('"'))
    has_marks = text.contains("\x01") | text.contains("\x02") | text.contains("\x03")
    rare = (text.contains("NaN") | text.contains("Infinity")) & ~has_marks
    return F.when(rare, unmarked(quoted)).otherwise(text)


def with_json(rows: DataFrame, text: str, into: str) -> DataFrame:
    """Add the parsed form of a text that is exactly one JSON document, else NULL.

    ``try_parse_json`` stops after the first document and ignores what follows, so the
    text is parsed as the only element of ``[[ text ]]``, where trailing text is an error.
    The one way to escape is to close both brackets early; then the text has ``]]`` in it
    and a second parse as an object member, where ``]`` cannot close anything, decides.

    The VARIANT stays enclosed (the document is at ROOT), as taking the document out would
    build it a second time. It is a column of its own before it is looked at, so that it
    is parsed once.
    """
    source = F.col(text)
    member = F.try_parse_json(F.concat(F.lit('{"d":'), source, F.lit("}")))
    parsed = F.col("_enclosed")
    single = F.try_variant_get(parsed, "$[0][1]", "variant").isNull() & (
        F.try_variant_get(parsed, "$[1]", "variant").isNull()
    )
    trusted = ~source.rlike(r"\]\s*\]") | member.isNotNull()
    # looked into only where it does not begin as the documents of queues do
    blank = ~source.startswith("{") & (F.ltrim(source, F.lit(_BLANKS)) == "")
    return (
        rows.withColumn("_enclosed", F.try_parse_json(enclosed(source)))
        .withColumn(into, F.when(F.is_valid_utf8(source) & ~blank & single & trusted, parsed))
        .drop("_enclosed")
    )


def object_fields(document: Column, keys: Iterable[str]) -> Column:
    """STRUCT of VARIANTs for the given keys, NULL when the document is not an object."""
    layout = ", ".join(f"{key}: variant" for key in keys)
    return F.try_variant_get(document, ROOT, f"struct<{layout}>")


def object_keys(document: Column) -> Column:
    """The keys of the document, NULL when it is not an object. Its text is not parsed again, and the
    values, of a type that hardly one has, are not read."""
    found = F.try_variant_get(document, ROOT, "map<string,map<string,boolean>>")
    return F.map_keys(found)


def field(document: Column, key: str) -> Column:
    """One key of the document as a VARIANT."""
    return F.try_variant_get(document, f"{ROOT}.{key}", "variant")


def is_object_text(text: Column) -> Column:
    """Of a text known to be JSON: whether the document is an object."""
    return text.startswith("{") | F.ltrim(text, F.lit(_BLANKS)).startswith("{")


def kind(value: Column) -> Column:
    """Type name of a variant: BIGINT, DECIMAL(p,s), DOUBLE, BOOLEAN, STRING, VOID, ..."""
    return F.schema_of_variant(value)


def is_number(kind_: Column) -> Column:
    """Numbers and booleans; both take part in arithmetic."""
    return kind_.isin("BIGINT", "DOUBLE", "BOOLEAN") | kind_.startswith("DECIMAL")


def is_present(value: Column) -> Column:
    """Key present with something other than ``null``."""
    return value.isNotNull() & ~F.is_variant_null(value)


def is_composite(kind_: Column) -> Column:
    return kind_.startswith("ARRAY") | kind_.startswith("OBJECT")


def as_double(value: Column) -> Column:
    return F.when(
        kind(value) == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("double")
    ).otherwise(F.try_variant_get(value, "$", "double"))


def as_bigint(value: Column) -> Column:
    """Integer part of a number; NULL beyond 64 bits."""
    return F.when(
        kind(value) == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("bigint")
    ).otherwise(F.try_variant_get(value, "$", "bigint"))


def cut_bytes(text: Column, first: int = 0, last: int = 0) -> Column:
    """The text without that many bytes at its ends, which must be ASCII.

    Cutting by characters counts all of them, which takes longer than the rest of writing a document.
    """
    size = F.octet_length(text)
    return F.substring(text.cast("binary"), F.lit(1 + first), size - first - last).cast("string")


def object_body(json_object: Column) -> Column:
    """The members of a JSON object text without its braces, NULL when there are none."""
    return F.when(F.octet_length(json_object) > 2, cut_bytes(json_object, 1, 1))
