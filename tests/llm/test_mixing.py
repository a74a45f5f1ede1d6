import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from relaymill.llm import mixing as M
from relaymill.llm.ordered import ranged, running


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def filled(sizes, weights, budget):
    """The contract's words: targets stop at 2 times the size, the excess is reshared."""
    full, target = set(), {}
    while True:
        open_ = [s for s in sizes if s not in full]
        rest = budget - sum(2 * sizes[s] for s in full)
        for s in open_:
            target[s] = rest * weights[s] / sum(weights[o] for o in open_)
        above = [s for s in open_ if target[s] > 2 * sizes[s]]
        if not above:
            return target
        full |= set(above)
        target |= {s: 2.0 * sizes[s] for s in above}


def plain(rows):
    """(doc_id, text, source) served one by one from the queue that finishes first."""
    queues, sizes = defaultdict(list), Counter()
    for i, (doc_id, text, source) in enumerate(rows):
        name = "-" if doc_id is None else str(doc_id)
        drawn = hashlib.md5(f"{name}|{hashlib.md5((text or '').encode()).hexdigest()}".encode()).hexdigest()
        queues[source].append((drawn, doc_id is not None, doc_id or 0, i))
        sizes[source] += size(text)
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target = filled(sizes, weights, 1.5 * sum(sizes.values()))
    served = []
    for k, s in enumerate(names):
        ahead = 0
        for round_ in (0, 1):
            for place in sorted(queues[s]):
                n = size(rows[place[3]][1])
                words = max(0, min(n, math.ceil(target[s] - ahead)))
                served.append(((ahead + words) / weights[s], k, place[:3], round_, place[3], words))
                ahead += n
    rest, taken = math.floor(1.5 * sum(sizes.values())), Counter()
    for *_, i, words in sorted(served):
        taken[i] += min(words, rest)
        rest -= min(words, rest)
    return [(d, size(t), sizes[s], round(target[s], 6), taken[i]) for i, (d, t, s) in enumerate(rows)]


def digest(served):
    out = served.groupBy("row", "doc_id", "size", "source_size", "target").agg(F.sum("words").alias("n"))
    return sorted(((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.n) for r in out.collect()), key=repr)


def as_docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_serving_one_by_one(spark, seed):
    rows = []
    for i in range(300):  # one source has a third of the rows, one very few words
        source = (None, "a", "é", "z", "b" * 3)[i % 5] if i % 3 else "hot"
        words = (i * seed * 7919) % 90 if source != "z" else i % 2
        rows.append((i, " ".join(f"w{k}" for k in range(words)), source))
    assert digest(M.mixed(as_docs(spark, rows))) == sorted(plain(rows), key=repr)


def test_sources_come_near_their_targets_over_any_stretch(spark):
    rows = [(i, "x " * (1 + i * 31 % 40), "abc"[i % 3]) for i in range(900)]
    served = M.mixed(as_docs(spark, rows), carry=("source",)).where("words > 0").orderBy("place").collect()
    end = 0
    for r in served:  # gapless, and the budget is used up
        assert r.place == end
        end += r.words
    total = sum(size(t) for _, t, _ in rows)
    assert end == math.floor(1.5 * total)
    early = Counter()  # while all queues have documents, words are taken by weight
    for r in served:
        if r.place < total // 4:
            early[r.carried_source] += r.words
    whole = sum(early.values())
    for source, weight in zip("abc", (5, 2, 1)):
        assert abs(early[source] / whole - weight / 8) < 0.02
    near = Counter()
    for r in served:
        near[r.carried_source] += r.words
    targets = {r.carried_source: r.target for r in served}
    assert all(abs(near[s] - targets[s]) <= 3 for s in targets)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text, r.source) for r in odd_docs.collect()]
    clash = odd_docs.withColumns({c: F.lit("x") for c in ("size", "row", "part", "place", "queue", "weight")})
    assert digest(M.mixed(clash)) == sorted(plain(rows), key=repr)
    same = [(None, "a b c", "s")] * 50 + [(7, None, None), (7, "", None)]
    got = digest(M.mixed(as_docs(spark, same)))
    assert got == sorted(plain(same), key=repr) and got == digest(M.mixed(as_docs(spark, same[::-1])))
    assert digest(M.mixed(no_docs)) == []
    empty = as_docs(spark, [(1, None, "a"), (2, " ", None)])
    assert [r[-1] for r in digest(M.mixed(empty))] == [0, 0]


def test_other_weights_and_budgets(spark):
    rows = [(i, "x " * 10, "abcd"[i % 4]) for i in range(80)]
    served = M.mixed(as_docs(spark, rows), weights=(3, 1), budget=0.5, most=1.0)
    sums = {r.queue: (r.n, r.t) for r in served.groupBy("queue").agg(
        F.sum("words").alias("n"), F.max("target").alias("t")).collect()}
    assert sums == {"=a": (150, 150.0), "=b": (50, 50.0), "=c": (150, 150.0), "=d": (50, 50.0)}
    everything = M.mixed(as_docs(spark, rows), budget=9.0).agg(F.sum("words")).first()[0]
    assert everything == 2 * 800


def test_running_totals_over_ranges(spark):
    values = [(g, i, i * i % 7) for g in ("x", None, "y") for i in range(500 if g == "x" else 9)]
    rows = spark.createDataFrame(values, "g string, i int, v int").repartition(5)
    merging = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merging, "false")  # small as they are, let the ranges be several
    try:
        dealt = ranged(rows, "running", "g", "i")
    finally:
        spark.conf.set(merging, "true")
    got = running(dealt, ("g", "i"), {"s": F.col("v"), "n": F.lit(1)}, ("g",))
    seen, wanted = Counter(), []
    for g, i, v in values:
        wanted.append((g, i, seen[g, "s"], seen[g, "n"]))
        seen[g, "s"] += v
        seen[g, "n"] += 1
    assert sorted(map(tuple, got.select("g", "i", "s", "n").collect()), key=repr) == sorted(wanted, key=repr)
    assert got.select("part").distinct().count() > 1
