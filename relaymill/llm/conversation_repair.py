"""Conversation structure repair as lightest derivation (operator 13).

A conversation's rows are judged (blank, duplicate, truncated), and the cheapest edits are
sought that make its roles an optional system turn and pairs of user and assistant. The
search is Knuth's agenda over weighted deductions (`derivation`).

A conversation may be of any length. Its rows are numbered by running totals over ranges
(`ordered`) and cut into blocks of `BLOCK` rows. Each block is one small problem: the
lightest repair from every state of the grammar before it to every state after it. Blocks
are joined in order, again as deductions: what is held of a conversation is one
audit per state, one letter a row. At last the texts stream by in order and the audit is
applied to them; no text is held, but those of one conversation pass through one task, as
a digest of them all in order must.

Defined cases: a null in conv_id, turn, role or text counts as one space where it is text, conv_id
stays null in the result and null turns come first; rows of one turn are ordered by
role and text; an empty role has no place in the grammar; repeated rows are duplicates; conversations without rows after damage have zeros;
an empty table gives an empty result. Further columns of the input play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from relaymill.llm import derivation as D
from relaymill.llm.ordered import ranged, running
from relaymill.llm.tables import bounded_batches, materialised, table

BLOCK = 256
BLANKS = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
ORDER = ("conv_id", "turn", "role", "digest", "row")

_COUNTS = "blank long, duplicate long, truncated long"
BLOCKS = (
    f"conv_id long, block long, rows long, {_COUNTS}, illegal long, first string, last string, "
    "low long, high long, turns long, first_turn long, last_turn long, "
    "spans array<struct<before: int, after: int, cost: long, audit: string>>"
)
VERDICTS = f"conv_id long, gaps long, {_COUNTS}, illegal long, cost long, audit string"
REPAIRED = "conv_id long, place long, edit string, role string, text string"
DIGESTS = f"{VERDICTS}, repaired_sha256 string"


def _said(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after damage, which the checksum of conversation and turn decides."""
    key = F.concat(_said(F.col("conv_id")), F.lit(":"), _said(F.col("turn")))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        _said(F.col("role")).alias("role"),
        _said(F.col("text")).alias("text"),
        (F.crc32(key) % 20).alias("harm"),
    )
    harm = F.col("harm")
    copies = F.when(harm == 0, F.lit(0)).when(harm == 3, F.lit(2)).otherwise(F.lit(1))
    return (
        rows.withColumn("copy", F.explode(F.array_repeat(F.lit(1), copies)))
        .withColumn(
            "text",
            F.when(harm == 1, F.lit(""))
            .when(harm == 2, F.translate("text", "".join(ENDS), ""))
            .otherwise(F.col("text")),
        )
        .withColumn("role", F.when(harm == 4, F.lit("user")).otherwise(F.col("role")))
        .drop("harm", "copy")
    )


def judged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) in blocks, with their first fault and without their texts."""
    trimmed = F.rtrim(F.col("text"), F.lit(BLANKS))
    narrow = rows.select(
        *ORDER, "part",
        F.substring("role", 1, 1).alias("initial"),
        (trimmed == "").alias("is_blank"),
        (~F.substring(trimmed, -1, 1).isin(*ENDS)).alias("is_open"),
    )
    numbered = materialised(
        running(narrow, ORDER, {"pos": F.lit(1)}, ("conv_id",)).drop("part", "row"), "turns-numbered"
    )
    # counted before the shuffle, so copies of one row do not gather
    firsts = numbered.groupBy("conv_id", "role", "digest").agg(F.min("pos").alias("pos"))
    firsts = firsts.select(F.col("conv_id").alias("_conv"), F.col("pos").alias("_pos"))
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("pos") == F.col("_pos"))
    fault = (
        F.when(F.col("is_blank"), F.lit(D.BLANK))
        .when(F.col("_pos").isNull(), F.lit(D.DUPLICATE))
        .when(F.col("is_open"), F.lit(D.TRUNCATED))
        .otherwise(F.lit(D.SOUND))
    )
    return numbered.join(firsts, same, "left").select(
        "conv_id", F.floor(F.col("pos") / BLOCK).alias("block"), "pos", "turn", "initial", fault.alias("fault")
    )


def _runs(batches: Iterator[pa.RecordBatch], *key: str) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Sorted rows as (key, its rows), one row at a time, across batches."""
    rows = (row for batch in batches for row in batch.to_pylist())
    return groupby(rows, key=lambda row: tuple(row[k] for k in key))


def _emitted(rows: Iterator[dict], layout: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in batches bounded by number and by text."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(v) for v in row.values() if isinstance(v, str))
        if len(held) >= 5000 or size > 4 << 20:
            yield pa.RecordBatch.from_pylist(held, schema=layout)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=layout)


def _streamed(
    rows: DataFrame, by: tuple[str, ...], order: tuple[str, ...], make: Callable[[Iterator], Iterator[dict]], layout: str
) -> DataFrame:
    """Apply `make` to the rows of each task, which holds whole groups, in order."""
    arrow = to_arrow_schema(StructType.fromDDL(layout))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _emitted(make(batches), arrow)

    return rows.repartition(*by).sortWithinPartitions(*order).mapInArrow(work, layout)


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for (conv_id, block), group in _runs(batches, "conv_id", "block"):
        rows = list(group)  # BLOCK of them at most
        given = [r["turn"] for r in rows if r["turn"] is not None]
        initials = [r["initial"] for r in rows]
        faults = [r["fault"] for r in rows]
        found = D.spans(list(zip(initials, faults)), D.STATES if block else (D.START,))
        yield {
            "conv_id": conv_id,
            "block": block,
            "rows": len(rows),
            "blank": faults.count(D.BLANK),
            "duplicate": faults.count(D.DUPLICATE),
            "truncated": faults.count(D.TRUNCATED),
            "illegal": sum(a + b not in D.LEGAL for a, b in zip(initials, initials[1:])),
            "first": initials[0],
            "last": initials[-1],
            "low": min(given, default=None),
            "high": max(given, default=None),
            "turns": len(set(given)),
            "first_turn": rows[0]["turn"],
            "last_turn": rows[-1]["turn"],
            "spans": [dict(zip(("before", "after", "cost", "audit"), s)) for s in found],
        }


def _verdict_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for (conv_id,), blocks in _runs(batches, "conv_id"):
        out = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        prefixes, last, turns, low, high = {D.START: (0, "")}, None, 0, None, None
        for block in blocks:
            if block["block"] < 0:  # says that the conversation is there
                continue
            for name in out:
                out[name] += block[name]
            turns += block["turns"]
            if last is not None:
                out["illegal"] += last["last"] + block["first"] not in D.LEGAL
                # turns ascend, so only the last one of a block may go on in the next
                turns -= block["first_turn"] is not None and block["first_turn"] == last["last_turn"]
            low = block["low"] if low is None else low
            high = block["high"] if block["high"] is not None else high
            spans = [(s["before"], s["after"], s["cost"], s["audit"]) for s in block["spans"]]
            prefixes, last = D.joined(prefixes, spans), block
        cost, audit = D.goal(prefixes)
        gaps = 0 if low is None else high - low + 1 - turns
        yield {"conv_id": conv_id, "gaps": gaps, **out, "cost": cost, "audit": audit}


def _repaired(group: Iterator[dict]) -> Iterator[tuple[str, str, str]]:
    """Of one conversation: first comes its verdict, then its rows in order."""
    repair = D.Repair(next(group)["audit"])
    for row in group:
        yield from repair.row(row["role"], row["text"])
    yield from repair.end()


def _repaired_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for (conv_id,), group in _runs(batches, "conv_id"):
        for place, (edit, role, text) in enumerate(_repaired(group)):
            yield {"conv_id": conv_id, "place": place, "edit": edit, "role": role, "text": text}


def _digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    names = [part.split()[0] for part in VERDICTS.split(", ")]
    for (conv_id,), group in _runs(batches, "conv_id"):
        verdict = next(group)
        whole, is_first = hashlib.sha256(), True
        for _, role, text in _repaired(chain([verdict], group)):
            whole.update((("" if is_first else "\n") + role + ":").encode())
            whole.update(text.encode())
            is_first = False
        yield {n: verdict[n] for n in names} | {"repaired_sha256": whole.hexdigest()}


class Repairs:
    """Verdicts on damaged conversations, and the repaired rows or their digests."""

    def __init__(self, conversations: DataFrame, broken: DataFrame):
        """`conversations` names all conversations, `broken` has their rows."""
        bounded_batches(conversations.sparkSession)
        tagged = broken.withColumns(
            {"digest": F.md5("text"), "row": F.monotonically_increasing_id()}
        )
        self.rows = ranged(tagged, "turns", *ORDER)
        there = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
        blocks = _streamed(
            judged(self.rows), ("conv_id", "block"), ("conv_id", "block", "pos"), _block_rows, BLOCKS
        ).unionByName(there.withColumn("block", F.lit(-1).cast("long")), allowMissingColumns=True)
        self.verdicts = materialised(
            _streamed(blocks, ("conv_id",), ("conv_id", "block"), _verdict_rows, VERDICTS), "verdicts"
        )

    def _side_by_side(self) -> DataFrame:
        """Every conversation's verdict and then its rows."""
        heads = self.verdicts.withColumn("kind", F.lit(0))
        rows = self.rows.select(*ORDER, "text").withColumn("kind", F.lit(1))
        return heads.unionByName(rows, allowMissingColumns=True)

    def repaired(self) -> DataFrame:
        """The rows of the repaired conversations with the edit that each owes its form to."""
        return self._applied(_repaired_rows, REPAIRED)

    def digests(self) -> DataFrame:
        """Every conversation's verdict with the digest of its repaired rows."""
        return self._applied(_digest_rows, DIGESTS)

    def _applied(self, make: Callable, layout: str) -> DataFrame:
        order = ("conv_id", "kind", *ORDER[1:])
        return _streamed(self._side_by_side(), ("conv_id",), order, make, layout)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return Repairs(conversations, damaged(conversations)).digests()
