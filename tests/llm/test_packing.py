import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from relaymill.llm import byte_tokens
from relaymill.llm import packing as P

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_ids_equal_the_library(library):
    encoder = byte_tokens.Encoder(PATH)
    rng = random.Random(5)
    alphabet = "aabeetTHEé \n\t\x0b\x0c\x1c\x85\xa0 　K'’s0123٣½#*$漢字😀é̈\x00"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["x<|endoftext|>Y <|endoftext|>", "<|endoftext|>" * 2, "", "it's we'll", " " * 500, "a" * 3000]
    for text in texts:
        assert encoder.encode(text) == library.encode(text, add_special_tokens=False).ids, text
    for ids in ([], [1, 2], [1, 70_000]):
        assert byte_tokens.from_bytes(byte_tokens.to_bytes(ids)).tolist() == ids


@pytest.mark.parametrize(
    "text",
    [
        " " * 2_000_000,
        "\n" * 2_000_000,
        "ab" + " " * 120_000 + "cd <|endoftext|> x" + "\n" * 60_000 + "'s",
        "x " + " \n\t\u3000\x85" * 20_000 + "!",
        "q" + "\t" * 70_000,
        "a" + " " * 60_000 + "\x1c" * 60_000 + "b",
    ],
)
def test_long_runs_of_white_space(library, text):
    assert byte_tokens.Encoder(PATH).encode(text) == library.encode(text, add_special_tokens=False).ids


def deviation(rows, target, window):
    """Per window, until the first queue of its lane is empty: sum of |share - target|."""
    windows, lanes = defaultdict(Counter), defaultdict(list)
    last = {}
    for r in rows:
        windows[r.sequence_id][r.source] += r.length
        lane = r.sequence_id >> 32
        last[lane, r.source] = max(last.get((lane, r.source), 0), r.sequence_id)
    ends = {}
    for (lane, _), sequence in last.items():
        ends[lane] = min(ends.get(lane, sequence), sequence)
    return [
        sum(abs(counts[s] / window - share) for s, share in target.items())
        for sequence, counts in windows.items()
        if sequence < ends[sequence >> 32]
    ]


@pytest.mark.parametrize("targets", [None, {f"src{i}": 0.025 if i % 2 else 0.075 for i in range(20)}])
def test_twenty_sources_in_every_window(spark, targets):
    """At the settings of the query, with the sources' own shares and with given ones."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = P.packed(docs, PATH, targets).collect()
    total, own = sum(r.length for r in rows), Counter()
    for r in rows:
        own[r.source] += r.length / total
    off = deviation(rows, targets or own, P.WINDOW)
    assert len(off) > 20 and np.mean(off) < 0.2


def test_a_rare_source_is_owed_what_lanes_without_it_had(spark):
    docs = spark.createDataFrame(
        [(i, "a b c d e f g h", "big") for i in range(400)] + [(1000, "x " * 300, "rare")],
        "doc_id long, text string, source string",
    )
    ids = P.tokenised(docs, PATH).withColumn("lane", F.when(F.col("source") == "rare", 7).otherwise(F.col("doc_id") % 8).cast("int"))
    total = ids.agg(F.sum("n_tokens")).first()[0]
    plans = {(r.lane, r.source): r for r in P._lane_plans(ids, None, 8, total).collect()}
    before = ids.where("lane < 7").agg(F.sum("n_tokens")).first()[0]
    rare = plans[7, "rare"]
    assert len(plans) == 9 and abs(rare.carried - rare.share * before) < 1e-6
    assert abs(plans[7, "big"].carried + rare.carried) < 1e-6


def check(rows, texts, library, window):
    """Every id in one piece, windows gapless and full but for one a lane."""
    by_doc, by_window = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_window[r.sequence_id].append(r)
    assert sorted(by_doc) == sorted(texts)
    for doc_id, pieces in by_doc.items():
        ids = library.encode(texts[doc_id] or "", add_special_tokens=False).ids + [1]
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            part = np.array(ids[at : at + p.length], dtype="<u4")
            assert p.ids_crc32 == zlib.crc32(part.tobytes())
            at += p.length
        assert at == len(ids)
    short = Counter()
    for sequence, pieces in by_window.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
        short[sequence >> 32] += at < window
    assert all(n <= 1 for n in short.values())


def test_query_packs_every_id_once(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    check(P.op9_packing(spark, SF).collect(), texts, library, P.WINDOW)


def test_windows_hold_target_shares_over_lanes(spark, library):
    rng = random.Random(2)
    words = "the of and to in is that for with was".split()
    rows = []
    for i in range(1500):
        source = "abc"[min(2, rng.randrange(4))]  # a quarter, a quarter, a half
        rows.append((i, " ".join(rng.choice(words) for _ in range(rng.randint(5, 200))), source))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = P.packed(docs, PATH, targets=None, window=256, lane_tokens=30_000, least_piece=16).collect()
    check(out, {r[0]: r[1] for r in rows}, library, 256)
    total = sum(r.length for r in out)
    share = Counter()
    for r in out:
        share[r.source] += r.length / total
    windows = defaultdict(Counter)
    for r in out:
        windows[r.sequence_id][r.source] += r.length
    lanes = defaultdict(list)
    for sequence, counts in windows.items():
        lanes[sequence >> 32].append((sequence, counts))
    assert len(lanes) > 3
    # until the first queue of a lane is empty, windows stay near the shares
    off = [
        abs(counts[s] / 256 - share[s])
        for found in lanes.values()
        for _, counts in sorted(found)[2 : len(found) // 2]
        for s in share
    ]
    assert np.mean(off) < 0.05


def test_explicit_targets_and_odd_rows(spark, odd_docs, no_docs, library):
    rows = P.packed(odd_docs, PATH, {"h0": 0.7, "h1": 0.2}).collect()
    assert sum(r.length for r in rows) == sum(
        len(library.encode(t or "", add_special_tokens=False).ids) + 1
        for (t,) in odd_docs.select("text").collect()
    )
    assert P.packed(no_docs, PATH).count() == 0
    clash = odd_docs.withColumns({"lane": F.lit("x"), "share": F.lit("y"), "ids": F.lit(0)})
    assert P.packed(clash, PATH).count() > 0
