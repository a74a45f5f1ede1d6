"""N-gram Jaccard join with set-relation skipping (operator 1).

Two documents link when the Jaccard similarity of their sets of distinct 4-word shingles is
0.85 or more. The result is exact (up to equal 56-bit hashes of different shingles).

1. A table of counters over all documents gives every shingle a class of frequency. The
   table has a fixed size; collisions only make the order of shingles less sharp.
2. Every text becomes a sorted set; equal sets fall together under one signature.
3. Index lists over the first shingles of each set (linked sets share one of them) yield
   candidate pairs. Lists are sorted by set size, in blocks that are skipped by position and
   size. Bitmaps of fixed size prove most pairs unlinked. Lists that are too long for pairs
   tie their sets to one of them instead; nothing is left out.
4. Components of the candidate graph bring the sets that may be linked together, each set
   once. In a component the answers of a set are derived from those of a similar one. A
   component too large for a task is cut into blocks, and every pair of blocks is a task.
5. Components of the links give the result.

Defined cases: A to Z are lower-cased; a text with fewer than four words is one shingle; a
null text or one without words has an empty set and is linked with nothing; repeated rows
are members like others; null ids take part but are never the smallest; an empty table gives
an empty result; clashing columns of the input play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relaymill.llm import shingle_sets
from relaymill.llm.components import components
from relaymill.llm.tables import materialised, table

LONGEST_LIST = 64
TASK_SHINGLES = 8_000_000
COUNTER_PARTS = 64
MARKS = 1 << 24  # bits of the filter over candidate signatures


def _class_table(docs: DataFrame) -> bytes:
    """Classes of frequency over all documents: COUNTERS bytes, whatever the input."""
    size = shingle_sets.COUNTERS // COUNTER_PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(shingle_sets.COUNTERS, dtype=np.int64)
        for batch in batches:
            shingle_sets.counted(batch.column("text"), counters)
        parts = np.minimum(counters, 65535).astype("<u2").reshape(COUNTER_PARTS, size)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(COUNTER_PARTS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())],
            names=["part", "counts"],
        )

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for counts in batch.column("counts"):
                total += np.frombuffer(counts.as_py(), dtype="<u2")
        classes = shingle_sets.class_table(total).tobytes()
        yield pa.RecordBatch.from_arrays(
            [pa.array([key[0].as_py()], pa.int32()), pa.array([classes], pa.binary())], names=["part", "classes"]
        )

    counted = docs.select("text").mapInArrow(count, "part int, counts binary")
    rows = counted.groupBy("part").applyInArrow(add, "part int, classes binary").collect()
    found = {r.part: r.classes for r in rows}
    return b"".join(found.get(k, bytes(size)) for k in range(COUNTER_PARTS))


def _described(docs: DataFrame, classes) -> DataFrame:
    """doc_id, set size, signature, first shingles and bitmap of every document."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(classes.value, dtype=np.uint8)
        for batch in batches:
            found = shingle_sets.sets(batch.column("text"), known)
            first = [s[: shingle_sets.prefix_length(len(s))].tobytes() for s in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array([len(s) for s in found], pa.int64()),
                    pa.array([shingle_sets.signature(s) for s in found], pa.int64()),
                    pa.array(first, pa.binary()),
                    pa.array([shingle_sets.bitmap(s) for s in found], pa.binary()),
                ],
                names=["doc_id", "n_shingles", "node", "first", "bits"],
            )

    schema = "doc_id long, n_shingles long, node long, first binary, bits binary"
    return docs.select("doc_id", "text").mapInArrow(describe, schema)


def _entries(nodes: DataFrame) -> DataFrame:
    """An index entry for each of the first shingles of each set."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("n_shingles").to_numpy()
            first = [np.frombuffer(b.as_py(), dtype=np.int64) for b in batch.column("first")]
            counts = np.array([len(f) for f in first], dtype=np.int64)
            if not counts.sum():
                continue
            position = np.concatenate([np.arange(c) for c in counts])
            sizes = np.repeat(size, counts)
            columns = [np.concatenate(first), np.repeat(batch.column("node").to_numpy(), counts)]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in columns), *(pa.array(c, pa.int32()) for c in (sizes, sizes - position))],
                names=["token", "node", "size", "rest"],
            )

    return nodes.mapInArrow(spread, "token long, node long, size int, rest int")


def _ties(entries: DataFrame, longest: int) -> DataFrame:
    """Candidate pairs (u, v) from lists of up to `longest` sets, and ties of longer lists.

    The lists of a partition arrive in order, so a task holds a batch and the open list. A
    list that grows beyond `longest` is not held: each of its sets is tied to its first one.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hub = None, None  # the open list; token and first set of a long one
        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in ("token", "node", "size", "rest")]
            if hub is not None:
                more = int(np.searchsorted(columns[0], hub[0], side="right"))
                yield _edges(np.full(more, hub[1]), columns[1][:more], True)
                columns = [c[more:] for c in columns]
                if not len(columns[0]):
                    continue
                hub = None
            if held is not None:
                columns = [np.concatenate(x) for x in zip(held, columns)]
            begin = int(np.searchsorted(columns[0], columns[0][-1], side="left"))
            held = [c[begin:] for c in columns]
            yield from _closed([c[:begin] for c in columns], longest)
            if len(held[0]) > longest:
                hub, held = (held[0][0], held[1][0]), None
                # written whole: the list is known to be long
                yield _edges(np.full(len(columns[0]) - begin, hub[1]), columns[1][begin:], True)
        if held is not None:
            yield from _closed(held, longest)

    lists = entries.repartition("token").sortWithinPartitions("token", "size", "node")
    return lists.mapInArrow(scan, "u long, v long, tied boolean")


def _closed(columns: list[np.ndarray], longest: int) -> Iterator[pa.RecordBatch]:
    if not len(columns[0]):
        return
    token, node, size, rest = columns
    first, second, long = shingle_sets.pairs_in_lists(token, node, size, rest.astype(np.int64), longest)
    pairs = np.unique(np.stack((first, second), axis=1), axis=0) if len(first) else np.zeros((0, 2), np.int64)
    yield _edges(pairs[:, 0], pairs[:, 1], False)
    if long.any():
        token, node = token[long], node[long]
        start = np.concatenate(([True], token[1:] != token[:-1]))
        hubs = node[start][np.cumsum(start) - 1]
        yield _edges(hubs, node, True)


def _edges(u: np.ndarray, v: np.ndarray, tied: bool) -> pa.RecordBatch:
    apart = u != v
    u, v = u[apart], v[apart]
    return pa.RecordBatch.from_arrays(
        [pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(np.full(len(u), tied))],
        names=["u", "v", "tied"],
    )


def _not_ruled_out(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs whose bitmaps allow a link."""
    bits = nodes.select("node", "n_shingles", "bits")
    both = pairs.join(bits.toDF("u", "n", "a"), "u").join(bits.toDF("v", "m", "b"), "v")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint64).reshape(batch.num_rows, -1)
                for c in ("a", "b")
            )
            n, m = (batch.column(c).to_numpy() for c in ("n", "m"))
            keep = pa.array(shingle_sets.may_link(a, b, n, m)) if batch.num_rows else pa.array([], pa.bool_())
            yield batch.select(["u", "v"]).filter(keep)

    return both.mapInArrow(test, "u long, v long")


def _marks(nodes: DataFrame) -> bytes:
    """A filter of MARKS bits that holds all of these nodes, and some others by chance."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(MARKS, dtype=bool)
        for batch in batches:
            bits[batch.column("node").to_numpy() & (MARKS - 1)] = True
        if bits.any():
            packed = np.packbits(bits).reshape(COUNTER_PARTS, -1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(COUNTER_PARTS), pa.int32()), pa.array([p.tobytes() for p in packed], pa.binary())],
                names=["part", "bits"],
            )

    def either(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(MARKS // 8 // COUNTER_PARTS, dtype=np.uint8)
        for batch in batches:
            for bits in batch.column("bits"):
                total |= np.frombuffer(bits.as_py(), dtype=np.uint8)
        yield pa.RecordBatch.from_arrays(
            [pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "bits"]
        )

    parts = nodes.mapInArrow(mark, "part int, bits binary").groupBy("part")
    found = {r.part: r.bits for r in parts.applyInArrow(either, "part int, bits binary").collect()}
    return b"".join(found.get(k, bytes(MARKS // 8 // COUNTER_PARTS)) for k in range(COUNTER_PARTS))


def _sets_of(docs: DataFrame, classes, marks) -> DataFrame:
    """The whole sets of the marked nodes, made again from the texts; one row per node."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(classes.value, dtype=np.uint8)
        bits = np.unpackbits(np.frombuffer(marks.value, dtype=np.uint8)).astype(bool)
        done: set[int] = set()
        for batch in batches:
            nodes, codes = [], []
            for found in shingle_sets.sets(batch.column("text"), known):
                node = shingle_sets.signature(found) if len(found) else 0
                if len(found) and bits[node & (MARKS - 1)] and node not in done:
                    done.add(node)
                    nodes.append(node)
                    codes.append(found.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.int64()), pa.array(codes, pa.binary())], names=["node", "codes"]
            )

    return docs.select("text").mapInArrow(make, "node long, codes binary").dropDuplicates(["node"])


def _with_blocks(groups: DataFrame, nodes: DataFrame, task_shingles: int) -> DataFrame:
    """(node, root, blocks, size): into how many blocks each candidate component is cut."""
    rows = groups.join(nodes.select("node", F.col("n_shingles").alias("size")), "node")
    blocks = F.ceil(F.sum("size") / F.lit(task_shingles)).cast("int")
    return rows.join(rows.groupBy("root").agg(blocks.alias("blocks")), "root")


def _links(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, root, whole) for the linked sets of every candidate component.

    `whole` says that the component was joined in one task, so that the root is final. A
    larger one is cut into blocks by a hash, and each set goes to all pairs of its block.
    """
    rows = sets.join(groups, "node")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    rows = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(
        "root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "codes", "blocks",
        "size",
    )
    rows = rows.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "size", "node")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, members, blocks = None, [], [], 1
        for batch in batches:
            for root, i, j, node, codes, many in zip(
                *(batch.column(c).to_pylist() for c in ("root", "i", "j", "node", "codes", "blocks"))
            ):
                if (root, i, j) != key:
                    yield from _joined(nodes, members, blocks)
                    key, nodes, members = (root, i, j), [], []
                blocks = many
                nodes.append(node)
                members.append(np.frombuffer(codes, dtype=np.uint64))
        yield from _joined(nodes, members, blocks)

    return rows.mapInArrow(join, "node long, root long, whole boolean")


def _joined(nodes: list[int], members: list[np.ndarray], blocks: int) -> Iterator[pa.RecordBatch]:
    if len(nodes) < 2:
        return
    label = shingle_sets.linked(members)
    apart = np.flatnonzero(label != np.arange(len(label)))
    if len(apart):
        node = np.array(nodes, dtype=np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(node[apart]), pa.array(node[label[apart]]), pa.array(np.full(len(apart), blocks == 1))],
            names=["node", "root", "whole"],
        )


def joined(docs: DataFrame, longest_list: int = LONGEST_LIST, task_shingles: int = TASK_SHINGLES) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    context = docs.sparkSession.sparkContext
    classes = context.broadcast(_class_table(docs))  # COUNTERS bytes
    described = materialised(_described(docs, classes), "sets")
    nodes = described.where("n_shingles > 0").dropDuplicates(["node"])
    ties = materialised(_ties(_entries(nodes), longest_list).distinct(), "ties")
    pairs = _not_ruled_out(ties.where("not tied").select("u", "v"), nodes)
    groups = components(pairs.unionByName(ties.where("tied").select("u", "v")))
    marks = context.broadcast(_marks(groups.select("node")))  # MARKS bits
    groups = materialised(_with_blocks(groups, described.dropDuplicates(["node"]), task_shingles), "groups")
    links = materialised(_links(groups, _sets_of(docs, classes, marks)), "links")
    roots = links.where("whole").select("node", "root")
    parts = links.where("not whole").select(F.col("node").alias("u"), F.col("root").alias("v"))
    if not parts.isEmpty():
        roots = roots.unionByName(components(parts).where("node != root"))
    rows = described.select("doc_id", "n_shingles", "node").join(roots, "node", "left")
    rows = rows.withColumn("class", F.coalesce("root", "node"))
    least = rows.groupBy("class").agg(F.min("doc_id").alias("least"))
    return rows.join(least, "class").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(table(spark, sf_dir, "documents").select("doc_id", "text"))
