"""Mixture-controlled packing into fixed windows (operator 9).

Documents are tokenised once and dealt into lanes by a hash, so that every lane holds its
share of every source. Within a lane each source has a queue. Deficit round-robin fills
window after window: every source earns its target share of the window as credit, sends
pieces from the head of its queue as long as its credit lasts, and carries what it has not
used into the next window. Deficits also carry over partitions: what a source had too little
or too much of in all lanes before is added to what it earns, in equal parts over the
windows of the lane, so that no window is given up to repaying.

Windows are cut freely through documents, so all of a lane's windows are full but its last:
the padding is less than one window a lane.

Defined cases: a null text is an empty document, which is the end mark alone; a null source
is a source of its own; equal or repeated documents are packed once each; an empty table
gives an empty result; clashing columns of the input play no part. A source that is not
named in the targets counts with its natural share.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relaymill.llm import byte_tokens
from relaymill.llm.ordered import ranged, running
from relaymill.llm.tables import materialised, table
from relaymill.llm.tokens import vocabulary_path

WINDOW = 2048
LANE_TOKENS = 1 << 20
# A source sends once it may send that many tokens, so those with 1.6 % or more are in every
# window; smaller pieces would be many rows for little.
LEAST_PIECE = 32
END_MARK = 1

TOKENISED = "doc_id long, source string, n_tokens long, ids binary"
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, source string"
)


def tokenised(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, source and the ids of each document with the end mark behind them.

    Ids are held as unsigned 16-bit numbers where all fit, else as 32-bit ones, with one
    leading byte that says which.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_tokens.Encoder(path)
        for batch in batches:
            counts, blobs = [], []
            for text in batch.column("text"):
                ids = encoder.encode(text.as_py() or "")
                ids.append(END_MARK)
                counts.append(len(ids))
                blobs.append(byte_tokens.to_bytes(ids))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    batch.column("source").cast(pa.string()),
                    pa.array(counts, pa.int64()),
                    pa.array(blobs, pa.binary()),
                ],
                names=["doc_id", "source", "n_tokens", "ids"],
            )

    return docs.select("doc_id", "source", "text").mapInArrow(encode, TOKENISED)


class DeficitRoundRobin:
    """The queues of one lane. Only tokens that are still waiting are held."""

    def __init__(self, share: dict, carried: dict, window: int, least: int):
        self.share, self.carried = share, carried
        self.window, self.least = window, least
        self.queues: dict = {s: deque() for s in share}
        self.tokens = 0

    def add(self, source, doc_id, ids: np.ndarray) -> None:
        self.queues[source].append([doc_id, ids, 0])
        self.tokens += len(ids)

    def _earnings(self) -> dict:
        """What each source earns per window: its share and a part of what it carries."""
        windows = max(1.0, self.tokens / self.window)
        due = {s: p * self.window for s, p in self.share.items()}
        return {s: max(d + self.carried[s] / windows, 0.1 * d) for s, d in due.items()}

    def pieces(self) -> Iterator[tuple]:
        """(doc_id, start, ids of the piece, tokens of the document, window, offset, source)."""
        number, room = 0, self.window
        earns, credit = self._earnings(), dict.fromkeys(self.share, 0.0)
        active = [s for s in sorted(self.queues, key=_order) if self.queues[s]]
        while active:
            total = sum(earns[s] for s in active)
            for s in active:  # a finished source's part goes to the others
                credit[s] += self.window * earns[s] / total
            # One round: those that are furthest behind their target come first.
            for s in sorted(active, key=lambda s: -credit[s]):
                queue = self.queues[s]
                while queue:
                    doc_id, ids, start = head = queue[0]
                    rest = len(ids) - start
                    if credit[s] < min(self.least, rest):
                        break
                    size = min(rest, room, max(int(credit[s]), 1))
                    yield doc_id, start, ids[start : start + size], len(ids), number, self.window - room, s
                    head[2] += size
                    room -= size
                    credit[s] -= size
                    if size == rest:
                        queue.popleft()
                    if not room:
                        number, room = number + 1, self.window
            active = [s for s in active if self.queues[s]]


def _order(source) -> tuple:
    return source is not None, source or ""


def packed(
    docs: DataFrame,
    path: str,
    targets: dict[str, float] | None = None,
    window: int = WINDOW,
    lane_tokens: int = LANE_TOKENS,
    least_piece: int = LEAST_PIECE,
) -> DataFrame:
    """The pieces of all documents, with `targets` as token proportions of the sources.

    Without targets every source keeps the share of tokens that it has in the table.
    """
    ids = materialised(tokenised(docs, path), "tokenised")
    total = ids.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n")).first().n
    lanes = max(1, -(-total // lane_tokens))
    lane = F.pmod(F.xxhash64("doc_id", "n_tokens", F.crc32("ids")), F.lit(lanes)).cast("int")
    ids = ids.withColumn("lane", lane)
    plans = _lane_plans(ids, targets, lanes, total)

    def pack(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _pack_lane(key, batches, window, least_piece)

    rows = ids.unionByName(plans, allowMissingColumns=True)
    return rows.groupBy("lane").applyInArrow(pack, PIECES)


def _lane_plans(ids: DataFrame, targets: dict[str, float] | None, lanes: int, total: int) -> DataFrame:
    """One row per lane and source in it: the source's share and what it carries.

    What a source carries into a lane is its share of all tokens of the lanes before, with or
    without documents of the source, less its own tokens there. The running sums go over
    whole lanes. `share` is set on these rows only, which tells them from documents.
    """
    sums = ids.groupBy("source", "lane").agg(F.sum("n_tokens").alias("tokens"))
    by_source = sums.groupBy("source").agg(F.sum("tokens").alias("source_tokens"))
    by_lane = sums.groupBy("lane").agg(F.sum("tokens").alias("lane_tokens"))
    passed = running(ranged(by_lane, "pack-lanes", "lane"), ("lane",), {"passed": F.col("lane_tokens")})
    natural = F.col("source_tokens") / F.lit(max(total, 1))
    if targets:
        named = F.create_map(*(x for k, v in targets.items() for x in (F.lit(k), F.lit(float(v)))))
        share = F.coalesce(F.try_element_at(named, F.coalesce("source", F.lit(""))), natural)
    else:
        share = natural
    shares = by_source.select(F.col("source").alias("of"), share.alias("share"))
    before = Window.partitionBy("source").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    return (
        sums.withColumn("sent", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
        .join(passed.select("lane", "passed"), "lane")
        .join(shares, F.col("source").eqNullSafe(F.col("of")))
        .withColumn("carried", F.col("share") * F.col("passed") - F.col("sent"))
        .select("lane", "source", "share", "carried")
    )


def _pack_lane(key, batches, window: int, least: int) -> Iterator[pa.RecordBatch]:
    lane = key[0].as_py()
    share, carried, waiting = {}, {}, []
    for batch in batches:
        for row in batch.select(["doc_id", "source", "ids", "share", "carried"]).to_pylist():
            if row["share"] is not None:
                share[row["source"]] = max(row["share"], 1e-9)
                carried[row["source"]] = row["carried"]
            else:
                waiting.append((row["source"], row["doc_id"], byte_tokens.from_bytes(row["ids"])))
    # an order of its own, so that a repeated task packs alike
    waiting.sort(key=lambda w: (_order(w[0]), w[1] is not None, w[1] or 0, len(w[2])))
    robin = DeficitRoundRobin(share, carried, window, least)
    for source, doc_id, ids in waiting:
        robin.add(source, doc_id, ids)
    out: list[tuple] = []
    for doc_id, start, ids, doc_tokens, number, offset, source in robin.pieces():
        checksum = zlib.crc32(ids.astype("<u4").tobytes())
        out.append((doc_id, start, len(ids), checksum, doc_tokens, (lane << 32) | number, offset, source))
        if len(out) == 10_000:
            yield _as_batch(out)
            out = []
    if out:
        yield _as_batch(out)


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"]
    types = [pa.int64()] * 7 + [pa.string()]
    arrays = [pa.array(column, kind) for column, kind in zip(zip(*rows), types)]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"))
