"""Mixing sources to target weights by weighted fair queueing (operator 11).

Every source is a queue of its documents in shuffled order, served again from the start once
it is through. A document gets a virtual finish time: the words of its source up to its
end, divided by the weight of the source. All queues together are range-sorted by that time
and cut where the total budget is used up, so every source gets its weighted part of any
stretch of the mix, and a source that is through leaves its part to the others.

What the cut takes from a source is also known beforehand: no more than `most` times its
words, else the budget left over by such sources in proportion to the weights. Only what
finishes before that is sorted, and the document in service there is cut at a word.

Sources, queues and the mix are summed range by range (`ordered`), so one source may hold
any part of the documents, and there may be any number of sources.

Defined cases: a null or empty text has no words, and takes no part in the mix; a null
source is the last source; a null doc_id is shuffled by its text; repeated rows are served
each; an empty table gives an empty mix. Further columns of the input play no part, also
where their names are used here, but for those that `carry` names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relaymill.llm.ordered import ranged, running
from relaymill.llm.tables import materialised, table

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MOST = 2.0
# A word, and the characters between words.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null; no list of them is made."""
    marks = F.translate(F.regexp_replace(text, WORD, "x"), BLANKS, "")
    return F.coalesce(F.octet_length(marks), F.lit(0)).cast("long")


def measured(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """The documents' sizes, queues and places in the shuffled order.

    `queue` orders like the source, null last. The place is drawn from id and text.
    """
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))
    return docs.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("~")).alias("queue"),
        word_count(F.col("text")).alias("size"),
        F.md5(F.concat(name, F.lit("|"), F.md5(F.coalesce("text", F.lit(""))))).alias("drawn"),
        *[F.col(c).alias(f"carried_{c}") for c in carry],
    )


def targets(
    rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: float = MOST
) -> tuple[DataFrame, float]:
    """Per queue its size, weight and target; and the total budget in words.

    Sources are filled like vessels of width `weight` up to one level. In the order of the
    level at which each is full, the first that does not get full tells the level.
    """
    sizes = rows.groupBy("queue").agg(F.sum("size").alias("source_size"))
    named = ranged(sizes, "mix-sources", "queue")
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    weighted = running(named, ("queue",), {"rank": F.lit(1)}).select(
        "queue", "source_size", turn.alias("weight"),
        (F.lit(most) * F.col("source_size") / turn).alias("full_at"),
    )
    levels = ranged(weighted, "mix-levels", "full_at", "queue")
    whole = levels.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    total = min(budget, most) * (whole.size or 0)
    below = running(
        levels,
        ("full_at", "queue"),
        {"filled": F.lit(most) * F.col("source_size"), "passed": F.col("weight")},
    )
    level = (F.lit(total) - F.col("filled")) / (F.lit(whole.weight) - F.col("passed"))
    found = (
        below.withColumn("level", level)
        .where("level <= full_at")
        .agg(F.min_by("level", F.struct("full_at", "queue")).alias("level"))
        .first()
    )
    full = F.lit(most) * F.col("source_size")
    share = F.lit(found.level) * F.col("weight")  # null where all get full
    wanted = levels.select(
        "queue", "source_size", "weight", F.coalesce(F.least(full, share), full).alias("target")
    )
    return wanted, total


def mixed(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    budget: float = BUDGET,
    most: float = MOST,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """The mix: a row for each time a document is served, and one for each that never is.

    `words` is how many of its words are taken then, `place` how many come before them in the mix,
    `round` how often its source was through before, `finish` the virtual finish time and
    `row` the number of the input row. Columns named in `carry` come along as `carried_<name>`.
    """
    rows = materialised(measured(docs, carry), "mix-measured")
    wanted, total = targets(rows, weights, budget, most)
    order = ("queue", "drawn", "doc_id", "row")
    queued = running(
        ranged(rows, "mix-queues", *order), order, {"ahead": F.col("size")}, ("queue",), wanted
    )
    left = F.ceil(F.col("target") - F.col("ahead"))
    rounds = F.sequence(F.lit(0), F.lit(max(1, math.ceil(most)) - 1))
    served = (
        queued.withColumn("round", F.explode(rounds))
        .withColumn("ahead", F.col("ahead") + F.col("round") * F.col("source_size"))
        .where("round = 0 OR ahead < target")
        .withColumn("words", F.greatest(F.lit(0), F.least("size", left)).cast("long"))
        .withColumn("finish", (F.col("ahead") + F.col("words")) / F.col("weight"))
        .drop("ahead", "part")
    )
    order = ("finish", "queue", "drawn", "doc_id", "round", "row")
    placed = running(ranged(served, "mix-order", *order), order, {"place": F.col("words")})
    rest = F.lit(math.floor(total)) - F.col("place")
    return placed.withColumn("words", F.greatest(F.lit(0), F.least("words", rest))).drop("part")


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    served = mixed(table(spark, sf_dir, "documents"))
    return (
        served.groupBy("row", "doc_id", "size", "source_size", "target")
        .agg(F.sum("words").alias("taken"))
        .drop("row")
    )
