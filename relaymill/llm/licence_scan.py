"""Licence scans (operator 2).

Texts are normalised and compared with licence templates by the Dice coefficient of their
word bigrams (see `licence_match`). The templates are few and fixed, so the table is scanned
where it lies: one pass, no shuffle.

Defined cases: a null or empty text has no match; equal texts have equal matches; of several
templates with the same Dice the first name wins; an empty table gives an empty result;
clashing columns of the input are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from relaymill.llm import arrays, licence_match, licence_texts
from relaymill.llm.tables import table

MATCH = pa.struct(
    [("licence", pa.string()), ("first_line", pa.int32()), ("last_line", pa.int32()), ("dice", pa.float64())]
)
_MATCH = T.StructType().add("licence", "string").add("first_line", "integer").add("last_line", "integer").add("dice", "double")
ADDED = T.StructType().add("licence", "string").add("dice", "double").add("matches", T.ArrayType(_MATCH))


def scanned(
    docs: DataFrame, templates: list[tuple[str, str]] | None = None, least: float = licence_match.LEAST
) -> DataFrame:
    """The documents with all `matches`, and the licence and Dice of the best one."""
    texts = templates or licence_texts.TEMPLATES
    names = [c for c in docs.columns if c not in ADDED.names]
    schema = T.StructType([*(docs.schema[c] for c in names), *ADDED.fields])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = licence_match.Templates(texts, least)
        for batch in batches:
            found = []
            for _, _, part in arrays.slices(batch.column("text")):
                found += licence_match.matches(part, known)
            best = [min(f, key=lambda m: (-m[3], m[2])) if f else (0, 0, None, None) for f in found]
            rows = [
                [{"licence": n, "first_line": a, "last_line": b, "dice": d} for a, b, n, d in f] for f in found
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(n) for n in names),
                    pa.array([b[2] for b in best], pa.string()),
                    pa.array([b[3] for b in best], pa.float64()),
                    pa.array(rows, pa.list_(MATCH)),
                ],
                names=[*names, *ADDED.names],
            )

    return docs.select(*names).mapInArrow(scan, schema)


def op2_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
