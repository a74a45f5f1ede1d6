import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from relaymill.llm import merkle as M

COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def cell(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels_over(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([H(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return levels


def climb(levels, i, digest):
    siblings = []
    for level in levels[:-1]:
        pair = level[i - i % 2 : i - i % 2 + 2]
        pair[i % 2] = digest
        siblings += [level[i ^ 1]] if len(pair) == 2 else []
        digest, i = H(*pair), i // 2
    return siblings, digest


def plain(rows):
    """Both trees in memory, a proof for each leaf."""
    trees = {}
    for r in rows:
        def leaf(n_chars, r=r):
            return H(*map(cell, (r.doc_id, r.source, r.lang, n_chars, r.text)))

        hit = None not in (r.doc_id, r.n_chars) and zlib.crc32(str(r.doc_id).encode()) % 7 == 0
        own = leaf(r.n_chars)
        start = leaf(r.n_chars + 1) if hit else own
        trees.setdefault(r.lang, []).append((r.doc_id is not None, r.doc_id or 0, own, start, r.doc_id))
    order = sorted(trees, key=lambda lang: (lang is not None, (lang or "").encode()))
    built = {}
    for lang in order:
        trees[lang].sort(key=lambda x: x[:4])
        built[lang] = levels_over([x[2] for x in trees[lang]])
    top = levels_over([built[lang][-1][0] for lang in order])
    out = []
    for k, lang in enumerate(order):
        for i, (_, _, own, start, doc_id) in enumerate(trees[lang]):
            low, digest = climb(built[lang], i, start)
            high, digest = climb(top, k, digest)
            root = top[-1][0]
            out.append((doc_id, own, built[lang][-1][0], root, H(*low, *high), digest, digest == root))
    return out


def proved(docs, levels=M.LEVELS):
    built = M.manifest(M.hashed(docs), levels)
    return sorted((tuple(r[c] for c in COLUMNS) for r in M.climbed(built, built.leaves).collect()), key=repr)


@pytest.mark.parametrize("sizes", [[1], [2], [3, 1], [1024, 1025, 5], [1, 1, 1, 1, 1], [700, 2049]])
def test_equals_trees_in_memory(spark, sizes):
    rows, names = [], [None, "de", "en", "Zz", "é"]
    for lang, n in zip(names, sizes):
        rows += [(i * 5 + len(rows), f"text {i}", lang, None if i % 4 == 0 else "s", i if i % 9 else None) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = proved(docs)
    assert got == sorted(plain(docs.collect()), key=repr)
    assert len({g[3] for g in got}) == 1


def test_links_on_links(spark):
    """With two levels a link, small trees take many; nodes on top are stored once per block."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(i, "t", lang, None, 1) for lang, n in (("en", 1300), ("fr", 1), ("es", 17), ("de", 16), (None, 5)) for i in range(n)]
    docs = spark.createDataFrame(rows, schema)
    assert proved(docs, 2) == sorted(plain(docs.collect()), key=repr)
    built = M.manifest(M.hashed(docs), 2)
    assert [r.tree for r in built.subroots.orderBy("rank").collect()] == ["-", "=de", "=en", "=es", "=fr"]
    steps = built.links.groupBy("tree", "step", "key").count()
    assert steps.agg(F.max("count"), F.max("step")).first()[:] == (1, 6 + 1)
    few = built.leaves.where("tree = '=en' AND pos IN (0, 3, 4, 1024, 1299)")
    got = sorted((tuple(r[c] for c in COLUMNS) for r in M.climbed(built, few).collect()), key=repr)
    assert len(got) == 5 and set(got) <= set(plain(docs.collect()))


def test_odd_rows(spark, odd_docs, no_docs):
    clash = odd_docs.withColumns({c: F.lit("x") for c in ("leaf", "tree", "row", "part", "pos", "start", "root")})
    assert proved(clash) == sorted(plain(odd_docs.collect()), key=repr)
    extra = [(None, "a", "en", "s", 3), (None, "b", None, "s", 3), (4, None, None, None, None), (4, "", "", "", 0)] * 3
    docs = spark.createDataFrame(extra, odd_docs.schema)
    assert proved(docs) == sorted(plain(docs.collect()), key=repr)
    assert proved(no_docs) == []


def test_tampering_is_found_and_the_row_limit_restored(spark):
    before = spark.conf.get(M.ROW_LIMIT, None)
    rows = M.op12_merkle(spark, "/root/testdata/sf0.001").collect()
    assert spark.conf.get(M.ROW_LIMIT, None) == before
    for r in rows:
        assert r.verified == (zlib.crc32(str(r.doc_id).encode()) % 7 != 0)
