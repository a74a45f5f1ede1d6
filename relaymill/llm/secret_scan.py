"""Secret scans with an incremental blob ledger (operator 5).

Every version of every path is addressed by the SHA-256 of its content. A ledger in shared
storage remembers which pairs of blob and rule version were scanned, and what was found.
A scan takes only the pairs the ledger lacks, appends them to it, and joins the findings
back to all paths and versions that hold the blob.

Spans count code points; the end is exclusive. Matches of one kind never overlap.

Defined cases: a null text is an empty blob; equal texts share one blob and so one scan;
an empty table gives an empty result; clashing columns of the input are replaced. If two
jobs scan the same blob at once, both write the same findings, and reading keeps one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relaymill.llm import secret_rules
from relaymill.llm.tables import fresh_folder, table
from relaymill.sources import files

SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
SPANS = "array<struct<kind:string,start:int,end:int>>"
LEDGER = f"blob string, rule_version string, spans {SPANS}"
MASK = "[secret]"


def blob_id(text: F.Column) -> F.Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _scanned(blobs: DataFrame) -> DataFrame:
    """Findings of every blob, also where there are none."""
    version = secret_rules.RULE_VERSION

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [
                [
                    {"kind": secret_rules.KINDS[k], "start": s, "end": e}
                    for s, e, k in secret_rules.scan((text.as_py() or "").encode())
                ]
                for text in batch.column("text")
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("blob"), pa.array([version] * len(spans)), pa.array(spans, pa.list_(SPAN))],
                names=["blob", "rule_version", "spans"],
            )

    return blobs.mapInArrow(scan, LEDGER)


class Ledger:
    """What was scanned and found so far: one folder per finished scan."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self) -> DataFrame | None:
        """All entries of finished scans under the present rules; None if there are none."""
        done = files.complete(self.spark, f"{self.folder}/*")
        if not done:
            return None
        entries = self.spark.read.schema(LEDGER).parquet(*done)
        return entries.where(F.col("rule_version") == secret_rules.RULE_VERSION)

    def update(self, versions: DataFrame) -> DataFrame:
        """Scan the blobs of `versions` that the ledger lacks; return all its entries.

        Copies fall together before the shuffle, so a blob with a third of all rows moves
        once per task; the texts are moved once.
        """
        blobs = versions.select(blob_id(F.col("text")).alias("blob"), "text").dropDuplicates(["blob"])
        known = self.read()
        if known is not None:
            blobs = blobs.join(known.select("blob"), "blob", "left_anti")
        _scanned(blobs).write.parquet(f"{self.folder}/scan-{uuid.uuid4().hex[:12]}")
        return self.read().dropDuplicates(["blob"])

    def compact(self) -> None:
        """Put all entries of the present rules into one folder. Not while scans run."""
        older = files.complete(self.spark, f"{self.folder}/*")
        self.read().dropDuplicates(["blob"]).write.parquet(f"{self.folder}/compact-{uuid.uuid4().hex[:12]}")
        for path in older:
            files.remove(self.spark, path)


def scanned(versions: DataFrame, folder: str | None = None) -> DataFrame:
    """The versions with `blob` and `spans`; `folder` holds the ledger between calls."""
    spark = versions.sparkSession
    ledger = Ledger(spark, folder or fresh_folder(spark, "secret-ledger"))
    taken = [c for c in ("blob", "spans", "rule_version") if c in versions.columns]
    versions = versions.drop(*taken)
    entries = ledger.update(versions.select("text")).select("blob", "spans")
    return versions.withColumn("blob", blob_id(F.col("text"))).join(entries, "blob", "left")


def masked(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """The documents with every secret in their texts replaced by a mark."""
    rows = scanned(docs, folder)
    schema = T.StructType([*docs.schema.fields])
    names = docs.columns

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column("text"), batch.column("spans")):
                spans = spans.as_py()
                texts.append(_without(text.as_py(), spans) if spans else text.as_py())
            columns = {n: batch.column(n) for n in names} | {"text": pa.array(texts, pa.string())}
            if "n_chars" in columns:
                lengths = [None if t is None else len(t) for t in texts]
                columns["n_chars"] = pa.array(lengths, batch.column("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return rows.select(*names, "spans").mapInArrow(mask, schema)


def _without(text: str, spans: list[dict]) -> str:
    out, at = [], 0
    for span in spans:  # by start; spans of different kinds may overlap
        if span["end"] <= at:
            continue
        if span["start"] >= at:
            out += [text[at : span["start"]], MASK]
        at = span["end"]
    return "".join([*out, text[at:]])


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = scanned(docs)
    base = F.filter("spans", lambda s: s["kind"].isin(*secret_rules.BASE_KINDS))
    counts = [_number_of(kind).alias(f"n_{kind}") for kind in secret_rules.BASE_KINDS]
    return rows.select(
        "doc_id",
        *counts,
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
        "blob",
    )


def _number_of(kind: str) -> F.Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def _joined(spans: F.Column) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
