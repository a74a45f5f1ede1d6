"""Byte-pair encoding of a documents table (operator 4).

The table is encoded where it lies: no shuffle, one pass. Every task reads the vocabulary
file, whose path is a parameter and must be readable on every executor; the Python worker
keeps it, and the ids of words it has met, up to a bounded number.

Defined cases: a null text is encoded as an empty one, with no ids; equal texts get equal
ids; an empty table gives an empty result; clashing columns of the input are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from relaymill.llm import bpe, per_process
from relaymill.llm.tables import table


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _encoder(path: str) -> bpe.Encoder:
    return per_process.kept(f"bpe:{path}", lambda: bpe.Encoder(bpe.Vocabulary(path)))


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """The documents with their `ids`."""
    names = [c for c in docs.columns if c != "ids"]
    schema = T.StructType(
        [*(docs.schema[c] for c in names), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            ids = [encoder.encode(t.as_py() or "") for t in batch.column("text")]
            columns = [*(batch.column(n) for n in names), pa.array(ids, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "ids"])

    return docs.select(*names).mapInArrow(encode, schema)


def decoded(docs: DataFrame, path: str) -> DataFrame:
    """Rows with `ids` and the text these stand for, in `decoded`."""
    names = [c for c in docs.columns if c != "decoded"]
    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField("decoded", T.StringType())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _encoder(path).vocabulary
        for batch in batches:
            texts = [bpe.decode(vocabulary, i.as_py() or []) for i in batch.column("ids")]
            columns = [*(batch.column(n) for n in names), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "decoded"])

    return docs.select(*names).mapInArrow(decode, schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the text decoded from them.

    Encoding and decoding in one pass, so that neither ids nor texts leave the task.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            counts, id_digests, text_digests = [], [], []
            for text in batch.column("text"):
                count, listed, decoded = encoder.spelled(text.as_py() or "")
                counts.append(count)
                id_digests.append(hashlib.sha256(listed.encode()).hexdigest())
                text_digests.append(hashlib.sha256(decoded.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(id_digests), pa.array(text_digests)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = T.StructType(
        [
            docs.schema["doc_id"],
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_sha256", T.StringType()),
            T.StructField("decoded_sha256", T.StringType()),
        ]
    )
    return docs.select("doc_id", "text").mapInArrow(digest, schema)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"))
