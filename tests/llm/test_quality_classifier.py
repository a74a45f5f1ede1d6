import random
import zlib

import pytest
from pyspark.sql import functions as F

from relaymill.llm import kneser_ney as K
from relaymill.llm import quality_classifier as Q
from tests.llm import brute

SF = "/root/testdata/sf0.01"


def test_scores_equal_the_textbook(spark, monkeypatch):
    monkeypatch.setattr(Q, "LEAST_SHARDS", 5)
    monkeypatch.setattr(Q, "BLOCK_BYTES", 2000)
    rng = random.Random(2)
    texts = ["".join(rng.choice("the of é漢\n") for _ in range(rng.randint(0, 300))) for _ in range(60)] + ["", "abcd", "abcde"]
    docs = spark.createDataFrame([(i, "en", t) for i, t in enumerate(texts)], "doc_id long, lang string, text string")
    model = Q.counted(docs.where("doc_id < 30"))
    assert model.shards_for(docs) == 5
    plain = brute.PlainKneserNey([t.encode() for t in texts[:30]])
    scores = {r.key: r for r in Q.scored(docs, model).collect()}
    for row in docs.withColumn("key", Q.row_key()).collect():
        expected = plain.log_perplexity(row.text.encode())
        got = scores[row.key]
        assert got.n_scored == max(0, len(row.text.encode()) - 4)
        assert got.log_perplexity == (None if expected is None else pytest.approx(expected, rel=1e-5))


def test_probabilities_add_up_to_one(spark):
    docs = spark.createDataFrame([(1, "en", "the cat and the dog and the end of it " * 3)], "doc_id long, lang string, text string")
    plain = brute.PlainKneserNey([docs.first().text.encode()])
    for history in (b"the ", b"zzzz", b"n th"):
        assert sum(plain.p(history + bytes([b])) for b in range(256)) == pytest.approx(1)


def test_query_keeps_good_and_rejects_most_bad_documents(spark):
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = Q.op3_quality_classifier(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    good = [r for r in rows if r.doc_id in labels and labels[r.doc_id].quality == 1]
    bad = [r for r in rows if r.doc_id in labels and labels[r.doc_id].quality == 0]
    assert sum(r.kept for r in good) >= 0.98 * len(good)
    assert sum(not r.kept for r in bad) >= 0.6 * len(bad)
    unseen = [r for r in good if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(r.kept for r in unseen) >= 0.95 * len(unseen) > 0


def test_kept_documents_and_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(3, 1, 0), (4, 1, 0), (None, 1, 0), (9, 0, 0)], "doc_id long, quality int, toxic int")
    clash = odd_docs.withColumns({"kept": F.lit("x"), "block": F.lit("y")})
    out = Q.kept_documents(clash, labels)
    assert out.columns == clash.columns
    rows = Q.classified(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count()
    none = labels.where("false")
    assert all(r.kept for r in Q.classified(odd_docs, none).collect())
    assert Q.kept_documents(odd_docs, none).count() == odd_docs.count()
    assert Q.classified(no_docs, labels).count() == 0


@pytest.mark.parametrize("trusted", [0, 6])
def test_a_language_with_few_trusted_documents_keeps_its_good_ones(spark, trusted):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    german = docs.where("lang = 'de'").select("doc_id")
    some = german.join(labels.where("quality = 1 and toxic = 0"), "doc_id").orderBy("doc_id").limit(trusted)
    fewer = labels.join(german, "doc_id", "left_anti").select("doc_id", "quality", "toxic").unionByName(
        some.select("doc_id", "quality", "toxic")
    )
    rows = Q.classified(docs, fewer).select("doc_id", "lang", "kept").collect()
    judged = {r.doc_id: r.quality for r in labels.collect()}
    good = [r for r in rows if r.lang == "de" and judged.get(r.doc_id) == 1]
    assert len(good) > 20 and all(r.kept for r in good)
    bad = [r for r in rows if r.lang != "de" and judged.get(r.doc_id) == 0]
    print(trusted, len(good), sum(not r.kept for r in bad), len(bad))
    assert sum(not r.kept for r in bad) >= 0.6 * len(bad)
