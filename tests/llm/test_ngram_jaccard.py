import random

import pytest

from pyspark.sql import functions as F

from relaymill.llm import ngram_jaccard as J
from relaymill.llm.components import components
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def key(row):
    return tuple((x is None, x or 0) for x in row)


def run(docs, frame, **limits):
    got = [tuple(r) for r in J.joined(frame, **limits).collect()]
    assert sorted(got, key=key) == sorted(brute.jaccard_components(docs), key=key)


def planted(seed=1, groups=25):
    """Texts near the threshold, in groups with a common passage."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(60)]
    docs = []
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.randint(20, 150))]
        if rng.random() < 0.5:
            base = base[:10] + passage + base[10:]
        for _ in range(rng.randint(1, 9)):
            text = list(base)
            for _ in range(rng.randint(0, 6)):
                text[rng.randrange(len(text))] = rng.choice(words)
            docs.append((len(docs) * 3 + 1, " ".join(text)))
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("limits", [{}, {"longest_list": 3}, {"longest_list": 3, "task_shingles": 900}])
def test_planted_copies_equal_brute_force(spark, limits):
    docs = planted()
    run(docs, spark.createDataFrame(docs, "doc_id long, text string").repartition(3), **limits)


def test_query_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in J.op1_ngram_jaccard(spark, SF).collect()]
    assert sorted(got) == sorted(brute.jaccard_components(docs))
    assert len({c for *_, c in got}) < len(got)


def test_one_large_group_of_near_copies(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(300)}" for _ in range(150)]
    docs = []
    for i in range(400):
        text = list(base)
        for _ in range(rng.randint(0, 5)):
            text[rng.randrange(len(text))] = f"v{rng.randrange(50)}"
        docs.append((i, " ".join(text)))
    run(docs, spark.createDataFrame(docs, "doc_id long, text string"))


def test_odd_rows(spark, odd_docs, no_docs):
    docs = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    docs += [(50, "A b C"), (51, "a B c"), (52, "a b"), (None, "a b"), (53, "a b c d"), (54, "A B C D")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    run(docs, frame.withColumns({"node": F.lit("x"), "size": F.lit(1)}))
    assert J.joined(no_docs).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randint(100, 400), rng.randint(100, 400)) for _ in range(150)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert found == {x: find(x) for a, b in edges if a != b for x in (a, b)}
