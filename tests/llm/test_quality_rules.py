from pyspark.sql import functions as F

from relaymill.llm import quality_rules as Q
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_measures_equal_brute_force_on_odd_texts(odd_docs):
    rows = Q.judged(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    for row in rows:
        expected = brute.quality(row.text)
        assert {k: row[k] for k in expected} == expected


def test_query_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = Q.op7_quality_rules(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for row in rows:
        expected = brute.quality(texts[row.doc_id])
        assert {k: row[k] for k in expected} == expected
        assert row.kept == (not row.base_failed and not row.host_refused)


def test_bad_host_loses_its_documents_and_small_hosts_are_shrunk(spark):
    good = "this is a clean line with more than ten different words in it today"
    bad = "same words come again here " * 6
    rows = [(i, good, f"good{i % 10}") for i in range(200)]
    rows += [(1000 + i, bad if i % 10 else good, "bad") for i in range(100)]
    rows += [(2000, bad, "tiny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r.doc_id: r for r in Q.judged(docs).collect()}
    assert all(out[i].kept for i in range(200))
    assert out[1000].host_refused and not out[1000].base_failed and not out[1000].kept
    verdicts = Q.host_verdicts(Q.measured(docs)).where(F.col("host") == "tiny").first()
    assert verdicts.rate_repeated < 1


def test_empty_table_and_clashing_columns(no_docs, odd_docs):
    assert Q.judged(no_docs).count() == 0
    clash = odd_docs.withColumns({"n_words": F.lit("x"), "kept": F.lit(1), "host": F.lit("y")})
    out = Q.judged(clash)
    assert dict(out.dtypes)["n_words"] == "bigint" and out.count() == odd_docs.count()
