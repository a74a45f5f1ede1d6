import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from relaymill.llm import quality_classifier, secret_rules
from relaymill.llm.tables import DOCUMENT_COLUMNS, materialised
from tests.llm import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """(name, input, output) of each stage over the smallest tables."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        made = materialised(stage(spark, docs, SF), "stage")
        out.append((name, docs, made))
        docs = made
    return {name: (before.collect(), after.collect()) for name, before, after in out}


def test_columns(stages):
    for name, (_, after) in stages.items():
        if name != "packing":
            assert tuple(after[0].asDict()) == DOCUMENT_COLUMNS


def test_rules_drop_what_plain_rules_drop(stages):
    before, after = stages["quality rules"]
    expected = {r.doc_id for r in before if not brute.quality(r.text)["base_failed"]}
    assert {r.doc_id for r in after} == expected and len(after) == len(expected)


def test_classifier_drops_its_rejects_only(spark, stages):
    before, after = stages["quality classifier"]
    docs = spark.createDataFrame(before)
    found = quality_classifier.classified(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rejected = {r.doc_id for r in found.where("not kept").collect()}
    assert {r.doc_id for r in after} == {r.doc_id for r in before} - rejected


def test_one_of_each_group_stays(stages):
    before, after = stages["n-gram Jaccard join"]
    groups = brute.jaccard_components([(r.doc_id, r.text) for r in before])
    expected = {d for d, _, c in groups if d == c}
    assert sorted(r.doc_id for r in after) == sorted(expected)


def test_near_copies_under_repeated_and_missing_ids(spark):
    """A document is its id and its text; two runs keep the same rows."""
    one, two = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    near = one.replace("a59", "x")
    rows = [
        (5, one, "en", "s", 1), (5, one, "de", "s", 1), (5, two, "en", "s", 2), (3, near, "en", "s", 3),
        (None, two, "en", "s", 2), (None, two, "en", "s", 2), (None, "alone here", "en", None, 4),
        (7, None, "en", "s", None), (7, "", "en", "s", 0), (None, None, None, None, None), (8, one, "en", "s", 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    wanted = [
        (3, near, "en", "s", 3), (5, two, "en", "s", 2), (None, "alone here", "en", None, 4),
        (7, None, "en", "s", None), (7, "", "en", "s", 0), (None, None, None, None, None),
    ]
    for part in (docs, docs.repartition(4, "text").orderBy(F.rand(1))):
        kept = corpus_pipeline.keep_one_of_near_copies(spark, part, SF)
        assert tuple(kept.columns) == DOCUMENT_COLUMNS
        got = sorted((tuple(r) for r in kept.collect()), key=repr)
        assert got == sorted(((d, t, lang, s, n) for d, t, lang, s, n in wanted), key=repr)


def test_no_secret_stays_and_the_rest_is_unchanged(stages):
    before, after = stages["secret scans"]
    texts = {r.doc_id: r.text for r in before}
    assert sorted(r.doc_id for r in after) == sorted(texts)
    for r in after:
        kinds = {secret_rules.KINDS[k] for *_, k in secret_rules.scan((r.text or "").encode())}
        assert not kinds & {"assign", "access", "hex"} and r.n_chars == len(r.text)
        if not secret_rules.scan(texts[r.doc_id].encode()):
            assert r.text == texts[r.doc_id]


def test_every_document_is_packed(stages):
    before, after = stages["packing"]
    lengths = {}
    for r in after:
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
        assert r.offset + r.length <= 2048
    assert sorted(lengths) == sorted(r.doc_id for r in before)
    assert all(lengths[r.doc_id] == r.doc_tokens for r in after)


def test_stages_on_odd_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs.withColumn("key", F.lit("x")).select(*DOCUMENT_COLUMNS), SF)
            out.count()
