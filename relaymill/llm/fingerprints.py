"""Document fingerprints by randomised edit embedding (operator 10).

See `edit_embedding` for the embedding. `fingerprinted` adds the fingerprint of each text;
`compared` also that of an edited text, made with the beginning of the next document, and
the likeness of the two and of neighbours; `near_duplicates` finds near copies: texts that
agree in a band of a sketch of their n-grams become candidates, and the edit distance decides.
The sampled places would not do for that: after a few per cent of edits two walks of some
thousand characters have little in common.

Defined cases: a null text counts as empty; an empty text has a fingerprint of zeros; equal
texts have equal fingerprints; the rows of equal doc_id are in the order of their texts, and
null ids come last; the next of the last document is the first, so a single document is its
own next one; an empty table gives an empty result; clashing columns are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relaymill.llm import edit_embedding, near_sketch
from relaymill.llm.tables import materialised, table

BLOCK_BYTES = 8 << 20
MOST_RANGES = 4096

COMPARED = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)


def fingerprinted(docs: DataFrame) -> DataFrame:
    """The documents with `fingerprint` (hex): one pass, no shuffle."""
    names = [c for c in docs.columns if c != "fingerprint"]
    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField("fingerprint", T.StringType())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column("text")]
            plain, _ = edit_embedding.fingerprints(texts, [(0, "")] * len(texts))
            hexed = pa.array([row.tobytes().hex() for row in plain], pa.string())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), hexed], names=[*names, "fingerprint"]
            )

    return docs.select(*names).mapInArrow(add, schema)


def _blocks(docs: DataFrame, block_bytes: int, most_ranges: int = MOST_RANGES) -> DataFrame:
    """Rows with `block`: ranges of doc_id in ascending order, of about `block_bytes` each.

    The ids are cut at quantiles, into `most_ranges` at most, and each of these ranges evenly
    into as many parts as are still needed. A few rows more or less in a block do no harm.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    number = max(1, -(-size // block_bytes))
    if number == 1:
        return docs.withColumn("block", F.lit(0).cast("bigint"))
    ranges = min(number, most_ranges)
    steps = [k / ranges for k in range(ranges + 1)]
    borders = sorted(set(docs.approxQuantile("doc_id", steps, 0.25 / ranges)))
    if len(borders) < 2:
        return docs.withColumn("block", F.lit(0).cast("bigint"))
    parts = -(-number // (len(borders) - 1))
    # a binary search over the borders, on the JVM
    found = Bucketizer(
        splits=[float("-inf"), *borders[1:-1], float("inf")], inputCol="_id", outputCol="_range", handleInvalid="keep"
    ).transform(docs.withColumn("_id", F.col("doc_id").cast("double")))
    at = F.col("_range").cast("int") + 1
    low = F.element_at(F.lit(borders[:-1]), at)
    high = F.element_at(F.lit(borders[1:]), at)
    part = F.floor(parts * (F.col("_id") - low) / F.greatest(high - low, F.lit(1.0)))
    part = F.least(F.greatest(part, F.lit(0)), F.lit(parts - 1))
    block = F.when(F.col("_id").isNull(), F.lit(parts * (len(borders) - 1) - 1)).otherwise(
        F.col("_range").cast("bigint") * parts + part
    )
    return found.withColumn("block", block.cast("bigint")).drop("_id", "_range")


def compared(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Fingerprints of texts and edited texts, and their likeness; one move of the texts.

    The rows are dealt into blocks of ascending ids. Each block also gets a guest: the first
    row of the next block, which its last row needs.
    """
    rows = _blocks(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), block_bytes)
    first = rows.groupBy("block").agg(F.min("doc_id").alias("first_id"))
    # one row per block; the block before the first is the last
    before = F.lag("block").over(Window.orderBy("block"))
    last = F.max("block").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    first = materialised(first.withColumn("to", F.coalesce(before, last)).drop("block"), "block-starts")
    guests = rows.join(first, F.col("doc_id").eqNullSafe(F.col("first_id"))).select(
        "doc_id", "text", F.col("to").alias("block"), F.lit(True).alias("guest")
    )
    rows = rows.withColumn("guest", F.lit(False)).unionByName(guests)
    return rows.groupBy("block").applyInArrow(_compare_block, COMPARED)


def _compare_block(block: pa.Table) -> pa.Table:
    ids, texts, guest = (block.column(c).to_pylist() for c in ("doc_id", "text", "guest"))
    order = sorted(range(len(ids)), key=lambda i: (guest[i], ids[i] is None, ids[i] or 0, texts[i]))
    own = sum(1 for g in guest if not g)
    order = order[: own + 1]  # of guests with equal ids the first is the next one
    ids, texts = [ids[i] for i in order], [texts[i] for i in order]
    edits = []
    for text, following in zip(texts[:own], texts[1:]):
        cut = len(text) // 4
        edits.append((len(text) - cut, following[:cut]))
    plain, edited = edit_embedding.fingerprints(texts, [*edits, (0, "")])
    sums = [
        hashlib.sha256((t[:keep] + tail).encode()).hexdigest() for t, (keep, tail) in zip(texts, edits)
    ]
    return pa.table(
        {
            "doc_id": pa.array(ids[:own], pa.int64()),
            "n_chars": pa.array([len(t) for t in texts[:own]], pa.int64()),
            "edited_sha256": pa.array(sums, pa.string()),
            "fingerprint": pa.array([p.tobytes().hex() for p in plain[:own]], pa.string()),
            "edited_fingerprint": pa.array([e.tobytes().hex() for e in edited[:own]], pa.string()),
            "near_edited": pa.array(np.mean(plain[:own] == edited[:own], axis=1), pa.float64()),
            "near_next": pa.array(np.mean(plain[:own] == plain[1 : own + 1], axis=1), pa.float64()),
        }
    )


def near_duplicates(docs: DataFrame, most_edits: float = 0.1) -> DataFrame:
    """Verified near copies: doc_id, near_id, edits.

    Of equal texts each is linked to the one with the smallest id (0 edits). Of different
    texts, each under its smallest id, all candidates are compared, and every pair whose edit
    distance is at most `most_edits` times the longer length is given, the greater id first.
    Candidates agree in a band of a sketch (see `near_sketch`). An id is null where a text
    only occurs without one; null ids count as the greatest.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where("text != ''")
    key = F.substring(F.unhex(F.sha2("text", 256)), 1, 16)
    copies = rows.select("doc_id", key.alias("key"))
    classes = materialised(rows.groupBy(key.alias("key")).agg(F.min("doc_id").alias("id"), F.first("text").alias("text")), "near-texts")

    place = Window.partitionBy("key").orderBy(F.col("doc_id").asc_nulls_last())
    ranked = copies.withColumns({"at": F.row_number().over(place), "near_id": F.first("doc_id").over(place)})
    equal = ranked.where("at > 1").select("doc_id", "near_id", F.lit(0).cast("bigint").alias("edits"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, bands = [], [], []
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                found = near_sketch.bands(text, most_edits)
                keys += [key] * len(found)
                sizes += [len(text)] * len(found)
                bands.append(found)
            found = np.concatenate(bands) if bands else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(found, pa.int64())],
                names=["key", "n", "band"],
            )

    bands = materialised(classes.select("key", "text").mapInArrow(sketch, "key binary, n long, band long"), "near-bands")
    other = bands.select(F.col("key").alias("near_key"), F.col("n").alias("m"), "band")
    pairs = (
        bands.join(other, "band")
        .where((F.col("key") > F.col("near_key")) & (F.abs(F.col("n") - F.col("m")) <= most_edits * F.greatest("n", "m") + 1e-9))
        .select("key", "near_key")
        .distinct()
    )
    near = classes.select(F.col("key").alias("near_key"), F.col("id").alias("near_id"), F.col("text").alias("near_text"))
    both = pairs.join(classes.withColumnRenamed("id", "doc_id"), "key").join(near, "near_key")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in batch.select(["doc_id", "near_id", "text", "near_text"]).to_pylist():
                most = int(most_edits * max(len(row["text"]), len(row["near_text"])) + 1e-9)
                if not near_sketch.may_be_near(row["text"], row["near_text"], most):
                    continue
                edits = edit_embedding.edit_distance(row["text"], row["near_text"], most)
                if edits <= most:
                    a, b = row["doc_id"], row["near_id"]
                    if b is None or (a is not None and a < b):
                        a, b = b, a
                    found.append((a, b, edits))
            columns = list(zip(*found)) if found else [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns], names=["doc_id", "near_id", "edits"]
            )

    return equal.unionByName(both.mapInArrow(verify, "doc_id long, near_id long, edits long"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(table(spark, sf_dir, "documents"))
