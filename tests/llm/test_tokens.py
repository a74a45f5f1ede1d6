import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from relaymill.llm import bpe, tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.Vocabulary(PATH))


def odd_texts():
    rng = random.Random(3)
    alphabet = "aabbeettTHEé ÉßΣσς  \n\t\x0b\x0c\x1c\x1f\x85\xa0 　İıK'’s0123٣½#*$漢字😀é̈́가"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["".join(chr(rng.randint(1, 0xD7FF)) for _ in range(40)) for _ in range(500)]
    texts += ["x<|endoftext|>Y <|startoftext|>", "<|endoftext|>" * 3, "it's WE'LL I'm can'T 's", "\x00", "a\x00b"]
    texts += ["thethethe" * 300, "é" * 700, "#" * 900, "ab" * 2000, ""]
    return texts


def test_encoding_and_decoding_equal_the_library(library, encoder):
    vocabulary = encoder.vocabulary
    for text in odd_texts():
        expected = library.encode(text, add_special_tokens=False).ids
        got = encoder.encode(text)
        assert got == expected, text
        assert bpe.decode(vocabulary, got) == library.decode(expected, skip_special_tokens=False)


def test_scan_and_heap_agree(encoder):
    rng = random.Random(1)
    for _ in range(300):
        symbols = [rng.choice("theinaorsd") for _ in range(rng.randint(1, 120))]
        symbols[-1] += "</w>"
        assert encoder._merged(symbols) == encoder._merged_long(symbols)


def test_words_are_spelled_back(encoder):
    vocabulary = encoder.vocabulary
    assert bpe.words_of(vocabulary, encoder.encode("The Café, 42 naïve 漢字")) == "the café , 4 2 naïve 漢字"


def test_query_equals_the_library(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = tokens.op4_bpe(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for row in rows:
        ids = library.encode(texts[row.doc_id], add_special_tokens=False).ids
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        decoded = library.decode(ids, skip_special_tokens=False)
        assert row.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_odd_rows(odd_docs, no_docs, library):
    clash = odd_docs.withColumn("ids", F.lit("x"))
    rows = tokens.decoded(tokens.encoded(clash, PATH), PATH).collect()
    assert len(rows) == odd_docs.count()
    for row in rows:
        assert row.ids == library.encode(row.text or "", add_special_tokens=False).ids
    assert tokens.encoded(no_docs, PATH).count() == 0
    assert tokens.digests(no_docs, PATH).count() == 0
