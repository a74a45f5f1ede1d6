"""Merkle dataset manifest with a recursive climb (operator 12).

Rows become leaves. The leaves of a language, in the order of doc_id, are hashed in pairs,
level by level, to the language's subroot; the subroots are hashed likewise to the root.

Levels are built ten at a time: 1,024 neighbours meet, are folded in one row, and what is
left of them goes on, so the shuffles are as many as the tree is high divided by ten. These
rows, each with its nodes level by level, are the lower part of the manifest. Above them a
node is a row linked to its parent, up to ten levels higher, with the siblings on the
way. A node high up would be asked for by all leaves below it, so its row is stored once
for every 1,024 leaves: no key of the climb is hot.

The climb is a recursive query of Spark: every leaf to be proved starts with the row of its
neighbours, then joins the row of its node, appends the siblings, folds them into its hash
and goes on with the parent, until a row that names the root ends it.

Defined cases: null cells are hashed as `-`; a null lang is the first language; rows with a null
doc_id come first and are never tampered with; rows with one doc_id are ordered by their
leaves, so equal rows are leaves beside each other; an empty table has no leaf and no root.
Further columns of the input play no part.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relaymill.llm.ordered import ranged, running
from relaymill.llm.tables import materialised, table

LEVELS = 10  # of the tree, by one link
UNROLLED = 1024  # rows that a task makes of one at once
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


@dataclass
class Manifest:
    """Written tables: `leaves` (row, tree, pos, doc_id, leaf), the `blocks` they lie in, the
    `links` above them, `subroots`."""

    leaves: DataFrame
    blocks: DataFrame
    links: DataFrame
    subroots: DataFrame
    levels: int


def _cell(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(n_chars: Column) -> Column:
    """The leaf of a row of documents with this n_chars."""
    cells = [F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text")]
    return F.sha2(F.concat(*map(_cell, cells)), 256)


def hashed(docs: DataFrame) -> DataFrame:
    """Leaves, and `start`: the leaf of the row as tampered with, or the leaf itself."""
    hit = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull()
    raised = F.col("n_chars").cast("decimal(20,0)") + 1
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("-")).alias("tree"),
        "doc_id",
        leaf_hash(F.col("n_chars")).alias("leaf"),
        F.when(hit, leaf_hash(raised)).alias("start"),
    )
    return rows.withColumn("start", F.coalesce("start", "leaf"))


def _height(leaves: Column) -> Column:
    """Levels above that many leaves: the bits of the last one's number."""
    return F.when(leaves > 1, F.length(F.bin(leaves - 1))).otherwise(F.lit(0))


def _paired(run: Column) -> Column:
    """The level above a run of nodes; the last may stay alone."""
    firsts = F.sequence(F.lit(0), F.size(run) - 1, F.lit(2))
    return F.transform(
        firsts, lambda i: F.sha2(F.concat(F.get(run, i), F.coalesce(F.get(run, i + 1), F.lit(""))), 256)
    )


def _as_bytes(runs: Column) -> Column:
    return F.transform(runs, lambda run: F.transform(run, F.unhex))


def _built(nodes: DataFrame, name: str, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """Blocks of each step, written, and the top of each tree.

    A block has the runs of its levels: its nodes, then what they fold to, up to `levels`
    levels or the top of the tree.
    """
    blocks, tops, step = [], [], 0
    highest = nodes.agg(F.max("height").alias("n")).first().n or 0
    while step == 0 or highest > levels * step:
        folds = F.least(F.lit(levels), F.col("height") - levels * step)
        counted = F.when(folds > 0, F.sequence(F.lit(1), folds)).otherwise(F.array().cast("array<int>"))
        gathered = nodes.groupBy("tree", F.shiftright("node", levels).alias("block")).agg(
            F.array_sort(F.collect_list(F.struct("node", "digest"))).alias("run"),
            F.max("leaves").alias("leaves"),
            F.max("height").alias("height"),
        )
        runs = F.aggregate(
            counted,
            F.array(F.col("run.digest")).cast("array<array<string>>"),
            lambda done, _: F.array_append(done, _paired(F.element_at(done, -1))),
        )
        stored = materialised(
            gathered.select("tree", "block", "leaves", "height", _as_bytes(runs).alias("runs")), f"{name}-{step}"
        )
        blocks.append(stored)
        step += 1
        digest = F.lower(F.hex(F.element_at(F.element_at("runs", -1), 1)))
        top = stored.select("tree", F.col("block").alias("node"), digest.alias("digest"), "leaves", "height")
        tops.append(top.where(F.col("height") <= levels * step))
        nodes = top.where(F.col("height") > levels * step)
    return blocks, reduce(DataFrame.unionByName, tops)


def _path(place: str) -> str:
    """SQL: the siblings on the way from a place in a block to its top, and on which side."""
    return (
        "transform(IF(size(runs) > 1, sequence(0, size(runs) - 2), array()), k -> struct("
        f"get(get(runs, k), shiftright({place}, k) ^ 1) AS sibling, shiftright({place}, k) % 2 = 1 AS on_left))"
    )


def _links(blocks: list[DataFrame], levels: int) -> DataFrame:
    """A row per node and step, with the siblings on its way to the top of its block."""
    found = []
    for step, stored in enumerate(blocks):
        nodes = f"inline(transform(sequence(0, size(runs[0]) - 1), i -> struct(i AS place, {_path('i')} AS path)))"
        found.append(
            stored.select("tree", "leaves", "height", "block", F.expr(nodes)).select(
                "tree", "leaves", "height", F.lit(step).alias("step"),
                (F.shiftleft("block", levels) + F.col("place")).alias("node"), "path",
            )
        )
    return reduce(DataFrame.unionByName, found)


def _shifted(value: Column, levels: Column) -> Column:
    return F.call_function("shiftright", value, levels)


def _steps(height: Column, levels: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(height / levels)).cast("int")


def _per_block(nodes: DataFrame) -> DataFrame:
    """Links from `low` to `high`, one for each block of leaves below a node (`key`).

    In two steps, so that the root of a large table is not unrolled by one task.
    """
    chunks = nodes.withColumn("low", F.explode(F.sequence("low", "high", F.lit(UNROLLED).cast("long"))))
    dealt = chunks.repartition("tree", "step", "low")
    keys = F.sequence("low", F.least("high", F.col("low") + (UNROLLED - 1)))
    return dealt.withColumn("key", F.explode(keys)).drop("low", "high")


def manifest(leaves: DataFrame, levels: int = LEVELS) -> Manifest:
    """Build all levels over leaves (row, tree, doc_id, leaf and others, which are kept)."""
    order = ("tree", "doc_id", "leaf", "row")
    dealt = ranged(leaves, "merkle-leaves", *order)
    sizes = dealt.groupBy("tree").agg(F.count(F.lit(1)).alias("leaves"))
    sizes = sizes.withColumn("height", _height(F.col("leaves")))
    placed = materialised(
        running(dealt, order, {"pos": F.lit(1)}, ("tree",), sizes).drop("part"), "merkle-placed"
    )
    bottom = placed.select(
        "tree", F.col("pos").alias("node"), F.col("leaf").alias("digest"), "leaves", "height"
    )
    blocks, tops = _built(bottom, "merkle-levels", levels)
    forest = ranged(tops.drop("node"), "merkle-forest", "tree")
    subroots = materialised(running(forest, ("tree",), {"rank": F.lit(1)}).drop("part"), "merkle-subroots")
    count = subroots.count()
    upper = subroots.select(
        F.lit("").alias("tree"), F.col("rank").alias("node"), "digest",
        F.lit(count).cast("long").alias("leaves"),
    ).withColumn("height", _height(F.col("leaves")))
    top_blocks, top = _built(upper, "merkle-root", levels)
    found = top.first()
    root = F.lit(found.digest if found else None).cast("string")

    none = F.lit(None).cast("string")
    last_block = F.shiftright(F.col("leaves") - 1, levels)
    below = levels * (F.col("step") - 1)
    low = F.call_function("shiftleft", F.col("node"), below)
    high = F.call_function("shiftleft", F.col("node") + 1, below) - 1
    above = _links(top_blocks, levels).select(F.col("step").alias("_step"), F.col("node").alias("_node"), "path")
    asked = subroots.withColumn("_step", F.explode(F.sequence(F.lit(0), F.lit(len(top_blocks) - 1))))
    outer = (
        asked.withColumn("_node", _shifted(F.col("rank"), levels * F.col("_step")))
        .join(above, ["_step", "_node"])
        .withColumns(
            {
                "low": F.lit(0).cast("long"),
                "high": last_block,
                "subroot": F.when(F.col("_step") == len(top_blocks) - 1, F.col("digest")),
                "root": F.when(F.col("_step") == len(top_blocks) - 1, root),
                "step": _steps(F.col("height"), levels) + F.col("_step"),
            }
        )
    )
    shown = ("tree", "step", "path", "subroot", "root")
    parts = [outer.select(*shown, "low", "high")]
    if blocks[1:]:
        within = _links(blocks[1:], levels).withColumn("step", F.col("step") + 1).withColumns({"subroot": none, "root": none})
        inner = within.withColumns({"low": low, "high": F.least(high, last_block)})
        parts.append(inner.select(*shown, "low", "high"))
    links = _per_block(reduce(DataFrame.unionByName, parts))
    return Manifest(placed, blocks[0], materialised(links, "merkle-links"), subroots, levels)


_FOLD = """aggregate(path, digest, (d, s) -> sha2(CASE WHEN s.sibling IS NULL THEN d
  WHEN s.on_left THEN concat(lower(hex(s.sibling)), d) ELSE concat(d, lower(hex(s.sibling))) END, 256))"""
_APPEND = "aggregate(path, proof, (p, s) -> concat(p, coalesce(s.sibling, CAST('' AS BINARY))))"


def _climb(levels: int) -> str:
    return f"""WITH RECURSIVE climb(doc_id, leaf, tree, block, step, digest, proof, subroot, root) AS (
  SELECT doc_id, leaf, tree, block, 1, {_FOLD}, {_APPEND}, CAST(NULL AS STRING), CAST(NULL AS STRING)
  FROM (SELECT doc_id, unhex(leaf) AS leaf, s.tree, s.block, start AS digest, CAST('' AS BINARY) AS proof,
               {_path(f"CAST(pos & {(1 << levels) - 1} AS INT)")} AS path
        FROM (SELECT *, shiftright(pos, {levels}) AS block FROM {{starts}}) s
        JOIN {{blocks}} b ON s.tree = b.tree AND s.block = b.block)
  UNION ALL
  SELECT c.doc_id, c.leaf, c.tree, c.block, c.step + 1, {_FOLD}, {_APPEND}, l.subroot, l.root
  FROM climb c JOIN {{links}} l ON c.tree = l.tree AND c.step = l.step AND c.block = l.key
  WHERE c.root IS NULL)
SELECT doc_id, lower(hex(leaf)) AS leaf, subroot, root, sha2(lower(hex(proof)), 256) AS proof_sha256,
       digest AS folded_root, digest = root AS verified
FROM climb WHERE root IS NOT NULL"""


def climbed(built: Manifest, starts: DataFrame) -> DataFrame:
    """Proofs of leaves from the bottom to the root, folded from the hash in `start`.

    `starts` has tree, pos, doc_id, leaf and start, like the manifest's own leaves.
    """
    spark = starts.sparkSession
    before = spark.conf.get(ROW_LIMIT, None)
    spark.conf.set(ROW_LIMIT, "-1")  # else the climb ends at a million rows
    try:
        return materialised(spark.sql(_climb(built.levels), starts=starts, blocks=built.blocks, links=built.links), "merkle-climbed")
    finally:
        spark.conf.unset(ROW_LIMIT) if before is None else spark.conf.set(ROW_LIMIT, before)


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = manifest(hashed(table(spark, sf_dir, "documents")))
    return climbed(built, built.leaves)
