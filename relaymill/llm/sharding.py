"""Sharding by fixed virtual slots (operator 8).

Records are hashed into a fixed number of virtual slots; bytes and rows are added up per
slot; a small versioned map says which shard holds which slot. Rebalancing edits the map:
each new version moves as few slots as it can, and records never change their slot. The map
has one row per slot, thousands whatever the size of the data, so it may be worked on by
the driver.

The law is `bytes`: shards hold nearly equal numbers of bytes.

Defined cases: a null text has size 16; a null doc_id is hashed like any other value; rows
that occur twice lie in the same slot and get places of their own there; an empty table
gives an empty result and a map of empty slots. Columns of the input that clash with the
added ones are replaced.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relaymill.llm.tables import fresh_folder, materialised, table

SLOTS = 8192
SHARDS = 40
ADDED = ("size", "text_crc32", "virtual_slot", "shard", "slot", "law", "grown_shard", "map_version")

SlotMap = list[int]  # the shard of every slot


def sized(docs: DataFrame) -> DataFrame:
    """Each record with its size, the checksum of its text and its virtual slot.

    The checksum joins the key in the hash, so records without a key, or with a common one,
    are spread as long as their texts differ.
    """
    text = F.coalesce("text", F.lit(""))
    docs = docs.drop(*(c for c in ADDED if c in docs.columns))
    return docs.withColumns(
        {
            "size": F.octet_length(text).cast("long") + 16,
            "text_crc32": F.crc32(text.cast("binary")),
        }
    ).withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(SLOTS)).cast("int"))


def slot_loads(records: DataFrame) -> list[int]:
    """Bytes of each virtual slot; summed before the shuffle, SLOTS rows at most."""
    rows = records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes")).collect()
    loads = [0] * SLOTS
    for row in rows:
        loads[row.virtual_slot] = row.bytes
    return loads


def first_map(shards: int) -> SlotMap:
    """Version 0: the slots dealt out evenly, before any load is known."""
    return [slot % shards for slot in range(SLOTS)]


def rebalanced(old: SlotMap, loads: list[int], shards: int, tolerance: float = 0.002) -> SlotMap:
    """An edited map under which the shards hold nearly equal numbers of bytes.

    Shards above the mean give slots away, largest first as long as they stay above it;
    these go, largest first, to the shard with the least. Single moves and swaps between the
    fullest and the emptiest shard then close the rest of the gap.
    """
    new = list(old)
    held: list[set[int]] = [set() for _ in range(shards)]
    homeless = []
    for slot, shard in enumerate(old):
        if shard < shards:
            held[shard].add(slot)
        else:
            homeless.append(slot)
    total = [sum(loads[s] for s in slots) for slots in held]
    mean = sum(loads) / shards
    for shard in range(shards):
        for slot in sorted(held[shard], key=lambda s: (-loads[s], s)):
            if total[shard] <= (1 + tolerance) * mean:
                break
            if loads[slot] and total[shard] - loads[slot] >= (1 - tolerance) * mean:
                held[shard].discard(slot)
                total[shard] -= loads[slot]
                homeless.append(slot)
    heap = [(total[shard], shard) for shard in range(shards)]
    heapq.heapify(heap)
    for slot in sorted(homeless, key=lambda s: (-loads[s], s)):
        _, shard = heapq.heappop(heap)
        held[shard].add(slot)
        total[shard] += loads[slot]
        heapq.heappush(heap, (total[shard], shard))
    for _ in range(4 * SLOTS):
        low, high = min(range(shards), key=total.__getitem__), max(range(shards), key=total.__getitem__)
        gap = total[high] - total[low]
        if gap <= tolerance * mean:
            break
        change = _best_exchange(held[high], held[low], loads, gap)
        if change is None:
            break
        give, take = change
        for slot, source, target in ((give, high, low), (take, low, high)):
            if slot is not None:
                held[source].discard(slot)
                held[target].add(slot)
                total[source] -= loads[slot]
                total[target] += loads[slot]
    for shard, slots in enumerate(held):
        for slot in slots:
            new[slot] = shard
    return new


def _best_exchange(full: set[int], empty: set[int], loads: list[int], gap: int):
    """The move or swap whose difference in bytes is nearest to half of the gap."""
    takes = sorted([(loads[s], s) for s in empty], key=lambda x: (x[0], x[1]))
    options = [(0, None), *takes]
    best, found = gap / 2, None
    at = 0
    for size, slot in sorted(((loads[s], s) for s in full), key=lambda x: (x[0], x[1])):
        while at + 1 < len(options) and size - options[at + 1][0] >= gap / 2:
            at += 1
        for k in (at, at + 1):
            if k < len(options):
                off = abs(size - options[k][0] - gap / 2)
                if off < best:
                    best, found = off, (slot, options[k][1])
    return found


class SlotMaps:
    """The versions of a slot map, one folder each, below a shared folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def write(self, version: int, shards: SlotMap, loads: list[int]) -> None:
        rows = [(slot, shard, loads[slot]) for slot, shard in enumerate(shards)]
        frame = self.spark.createDataFrame(rows, "virtual_slot int, shard int, bytes long")
        frame.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/version={version}")

    def read(self, version: int) -> DataFrame:
        """One row per slot: SLOTS rows, which bounds its size."""
        return self.spark.read.parquet(f"{self.folder}/version={version}").withColumn(
            "map_version", F.lit(version)
        )


def placed(records: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Records with their shard, and their place in it without gaps.

    A place is the number of rows in the shard's earlier virtual slots plus the place among
    the rows of the slot, so no task sorts more than the slots it was dealt.
    """
    counts = records.groupBy("virtual_slot").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        slot_map.join(counts, "virtual_slot", "left")
        .withColumn("start", F.coalesce(F.sum(F.coalesce("rows", F.lit(0))).over(before), F.lit(0)))
        .select("virtual_slot", "shard", "map_version", "start")
    )
    within = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return (
        records.withColumn("place", F.row_number().over(within) - 1)
        .join(F.broadcast(starts), "virtual_slot")  # SLOTS rows
        .withColumn("slot", F.col("start") + F.col("place"))
        .drop("start", "place")
    )


def sharded(docs: DataFrame, shards: int = SHARDS, folder: str | None = None) -> DataFrame:
    """All columns of the records, their shard and their place in it.

    Two versions of the map are left in `folder`: the even one and the rebalanced one.
    """
    return _sharded(sized(docs), shards, folder)


def _sharded(records: DataFrame, shards: int, folder: str | None) -> DataFrame:
    maps = SlotMaps(records.sparkSession, folder or fresh_folder(records.sparkSession, "slot-maps"))
    loads = slot_loads(records)
    first = first_map(shards)
    maps.write(0, first, [0] * SLOTS)
    maps.write(1, rebalanced(first, loads, shards), loads)
    out = placed(records, maps.read(1))
    return out.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts are read once; what follows works on keys and sizes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    records = materialised(sized(docs).drop("text"), "sized")
    shown = ("doc_id", "size", "text_crc32", "law", "shard", "grown_shard", "virtual_slot", "map_version")
    return _sharded(records, SHARDS, None).select(*shown, F.col("slot").cast("long").alias("slot"))
