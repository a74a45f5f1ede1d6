import zlib

from pyspark.sql import functions as F

from relaymill.llm import sharding as S
from relaymill.llm.tables import fresh_folder

SF = "/root/testdata/sf0.01"


def check(rows, texts_by_id=None):
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r.shard, []).append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < S.SHARDS
    for places in by_shard.values():
        assert sorted(places) == list(range(len(places)))


def test_query_places_every_document_and_balances_bytes(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = S.op8_sharding(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    load = [0] * S.SHARDS
    slots = {}
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert r.size == len(data) + 16 and r.text_crc32 == zlib.crc32(data)
        load[r.shard] += r.size
        assert slots.setdefault(r.virtual_slot, r.shard) == r.shard
    check(rows)
    assert max(load) - min(load) < 0.01 * sum(load) / S.SHARDS


def test_rebalancing_moves_little_and_keeps_slots(spark):
    loads = [(slot * 7919) % 1000 + (5000 if slot % 40 == 3 else 0) for slot in range(S.SLOTS)]
    first = S.first_map(40)
    second = S.rebalanced(first, loads, 40)
    assert max(_loads(second, loads, 40)) - min(_loads(second, loads, 40)) < 0.005 * sum(loads) / 40
    assert S.rebalanced(second, loads, 40) == second
    moved = sum(a != b for a, b in zip(first, second))
    assert moved < S.SLOTS / 20
    fewer = S.rebalanced(second, loads, 39)  # a shard goes: its slots find new places
    assert max(fewer) == 38
    grown = S.rebalanced(second, loads, 41)
    assert {b for a, b in zip(second, grown) if a != b} and max(grown) == 40


def _loads(slot_map, loads, shards):
    out = [0] * shards
    for slot, shard in enumerate(slot_map):
        out[shard] += loads[slot]
    return out


def test_odd_rows_versions_and_clashes(spark, odd_docs, no_docs):
    folder = fresh_folder(spark, "maps")
    rows = S.sharded(odd_docs.withColumn("shard", F.lit("x")), folder=folder).collect()
    assert len(rows) == odd_docs.count()
    check(rows)
    maps = S.SlotMaps(spark, folder)
    assert maps.read(0).count() == S.SLOTS == maps.read(1).count()
    assert S.sharded(no_docs).count() == 0
