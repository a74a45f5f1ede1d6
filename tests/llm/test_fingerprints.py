import hashlib
import random
import time

import numpy as np
from pyspark.sql import functions as F

from relaymill.llm import edit_embedding as E
from relaymill.llm import fingerprints as P

SF = "/root/testdata/sf0.001"


def slow_walk(text):
    """The embedding, one coin flip per step, by its definition."""
    classes = E._classes(np.array([ord(c) for c in text], dtype=np.uint32))
    stay = E._STAY.reshape(E.PERIOD, E.CLASSES)
    out, step = [], 0
    for i, c in enumerate(classes):
        while True:
            out.append(i)
            moves = stay[step % E.PERIOD, c] == 1
            step += 1
            if moves:
                break
    return out


def slow_fingerprint(text):
    if not text:
        return np.zeros(E.SLOTS, np.uint8)
    embedding = slow_walk(text)
    points = np.array([ord(c) for c in text], dtype=np.uint32)
    places = [max(p for p in E._PLACES[s] if p < len(embedding)) for s in range(E.SLOTS)]
    at = np.array([embedding[p] for p in places])
    return E._symbols(points, at, np.int64(len(points)))


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def some_texts(n=60):
    rng = random.Random(4)
    return ["".join(rng.choice("the of and é漢 😀\n") for _ in range(rng.randint(0, 400))) for _ in range(n)] + ["", "x"]


def test_fingerprints_equal_brute_force():
    texts = some_texts()
    rng = random.Random(6)
    edits = [(rng.randint(0, len(t)), rng.choice(texts)) for t in texts]
    plain, edited = E.fingerprints(texts, edits)
    for i, (text, (keep, tail)) in enumerate(zip(texts, edits)):
        assert (plain[i] == slow_fingerprint(text)).all()
        assert (edited[i] == slow_fingerprint(text[:keep] + tail)).all()


def test_few_edits_change_few_slots():
    rng = random.Random(8)
    base = "".join(rng.choice("abcdefghij klmnop") for _ in range(4000))
    likeness = []
    for edits in (0, 5, 40, 400):
        text = list(base)
        for _ in range(edits):
            at = rng.randrange(len(text))
            text[at : at + rng.choice((0, 1))] = rng.choice(("", "z", "y"))
        a, _ = E.fingerprints([base, "".join(text)], [(0, "")] * 2)
        likeness.append(np.mean(a[0] == a[1]))
    assert likeness[0] == 1 and likeness[1] > 0.9 and likeness[1] >= likeness[2] > likeness[3]


def test_edit_distance():
    rng = random.Random(9)
    for _ in range(400):
        a, b = ("".join(rng.choice("abé") for _ in range(rng.randint(0, 14))) for _ in range(2))
        assert E.edit_distance(a, b) == levenshtein(a, b)


def expected(docs):
    rows = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0, d[1] or ""))
    texts = [t or "" for _, t in rows]
    out = []
    for k, (doc_id, _) in enumerate(rows):
        text, following = texts[k], texts[(k + 1) % len(rows)]
        cut = len(text) // 4
        changed = text[: len(text) - cut] + following[:cut]
        a, b, c = (slow_fingerprint(t) for t in (text, changed, following))
        out.append(
            (doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), a.tobytes().hex(),
             b.tobytes().hex(), float(np.mean(a == b)), float(np.mean(a == c)))
        )
    return out


def test_blocks_equal_brute_force(spark):
    docs = [(3 * i, t) for i, t in enumerate(some_texts(80))] + [(9, "again"), (None, "no id"), (None, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for block in (1 << 24, 2000):
        rows = [tuple(r) for r in P.compared(frame, block).collect()]
        key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
        assert sorted(rows, key=key) == sorted(expected(docs), key=key)


def test_blocks_are_in_the_order_of_ids(spark):
    rng = random.Random(11)
    ids = [rng.randrange(-(10**6), 10**6) ** 3 for _ in range(3000)] + [None, None, 7, 7]
    frame = spark.createDataFrame([(i, "x" * 100) for i in ids], "doc_id long, text string")
    for ranges in (4, 4096):
        rows = P._blocks(frame, 3000, ranges).collect()
        placed = sorted((r.doc_id, r.block) for r in rows if r.doc_id is not None)
        assert [b for _, b in placed] == sorted(b for _, b in placed)
        assert {r.block for r in rows if r.doc_id is None} <= {max(b for _, b in placed), max(r.block for r in rows)}
        assert len({b for _, b in placed}) > 20


def test_query(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = P.op10_fingerprints(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    by_text = {}
    for r in rows:
        assert r.n_chars == len(texts[r.doc_id])
        assert by_text.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
    long = [r for r in rows if r.n_chars > 200]
    assert np.mean([r.near_edited for r in long]) > 0.6 > 0.3 > np.median([r.near_next for r in long])


def test_near_duplicates(spark):
    rng = random.Random(10)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(600)) for _ in range(20)]
    docs = [(i, t) for i, t in enumerate(base)] + [(100 + i, t[:300] + "!" + t[301:]) for i, t in enumerate(base[:10])]
    docs += [(200, base[0]), (201, ""), (202, None)]
    found = {(r.doc_id, r.near_id) for r in P.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {(100 + i, i) for i in range(10)} | {(200, 0)} <= found
    assert all(a - 100 == b or (a, b) in {(200, 0), (200, 100)} for a, b in found)


def test_odd_rows(odd_docs, no_docs):
    assert P.compared(odd_docs.withColumn("block", F.lit("x"))).count() == odd_docs.count()
    assert P.compared(no_docs).count() == 0
    assert P.fingerprinted(odd_docs.withColumn("fingerprint", F.lit(0))).count() == odd_docs.count()
    assert P.near_duplicates(no_docs).count() == 0


def edited(rng, text, share):
    """The text after scattered edits of single characters, a third of each kind."""
    out = list(text)
    for at in rng.sample(range(len(out)), int(share * len(out))):
        out[at] = rng.choice(("", "#", out[at] + "#"))
    return "".join(out)


def test_recall_over_rates_and_lengths(spark):
    """Of the pairs that brute force finds, nine in ten at each rate and length."""
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    docs, planted = [], {}
    for length in (30, 59, 61, 200, 2000, 8000):
        for rate in (0.01, 0.02, 0.04, 0.08, 0.095):
            for _ in range(30 if length < 8000 else 10):
                text = " ".join(rng.choice(words) for _ in range(length))[:length]
                copy = edited(rng, text, rate)
                edits = E.edit_distance(text, copy)
                docs += [(len(docs), text), (len(docs) + 1, copy)]
                if edits <= 0.1 * max(len(text), len(copy)):
                    planted.setdefault((length, rate), []).append((docs[-1][0], docs[-2][0], edits))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = {tuple(r) for r in P.near_duplicates(frame).collect()}
    for (length, rate), pairs in planted.items():
        hits = sum(p in found for p in pairs)
        print(length, rate, hits, len(pairs))
        assert hits >= 0.9 * len(pairs), (length, rate, hits, len(pairs))


def test_members_of_a_group_are_compared_with_each_other(spark):
    """Texts that share a passage, of which the smallest id is near none of the others; rows without an id."""
    rng = random.Random(13)
    some = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = some(1500)
    docs = [(0, passage + some(500))]
    for k in range(1, 9):
        text = passage + some(500)
        docs += [(10 * k, text), (10 * k + 1, edited(rng, text, 0.005))]
    docs += [(None, docs[1][1]), (None, edited(rng, docs[1][1], 0.005))]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = {tuple(r) for r in P.near_duplicates(frame).collect()}
    first = {}
    for a, x in docs:
        first.setdefault(x, a)
    expected = {(None, 10, 0)}
    for x, a in first.items():
        for y, b in first.items():
            edits = E.edit_distance(x, y)
            if (b is None, b or 0) < (a is None, a or 0) and edits <= 0.1 * max(len(x), len(y)):
                expected.add((a, b, edits))
    assert found == expected and any(a is None for a, *_ in found)


def test_distance_up_to_a_bound_and_with_long_common_ends():
    rng = random.Random(8)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    for _ in range(1500):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randint(0, 14))) for _ in range(2))
        edits = plain(a, b)
        assert E.edit_distance(a, b) == edits
        for most in range(6):
            found = E.edit_distance(a, b, most)
            assert found == edits if edits <= most else found > most
    long = "abcdefgh" * 60_000
    began = time.process_time()
    assert E.edit_distance("1" + long, "2" + long) == 1 == E.edit_distance(long + "1", long + "2")
    assert time.process_time() - began < 1
