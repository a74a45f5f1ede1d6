"""Quality rules with host verdicts (operator 7).

Each document is measured and tested by a few rules. The failures are added up per host,
each host's failure rates are shrunk towards the mean of all hosts by a beta prior that is
itself estimated from the hosts, and hosts whose shrunk rate is too high lose all their
documents.

Defined cases: a null text has no words and fails; a null host is a host of its own; rows
that occur twice are judged twice, and alike; an empty table gives an empty result. Columns
of the input that carry the name of a measure are replaced in `measured` and `judged`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relaymill.llm import arrays
from relaymill.llm.tables import materialised, table

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
WINDOW = 5

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class HostRule:
    """A host is refused for a rule if its shrunk failure rate is above `limit`.

    `min_documents` keeps tiny hosts out of the estimate of the prior, where their rates of
    0 or 1 would say little; they are judged like all others.
    """

    limit: float = 0.5
    min_documents: int = 5


def measure(text: pa.Array) -> dict[str, np.ndarray]:
    """The five measures of every text."""
    parts: list[tuple[np.ndarray, ...]] = []
    for _, _, part in arrays.slices(text):
        starts, ends, counts = part.words()
        in_word = ~arrays.IS_SPACE[part.data]
        characters = part.per_document(in_word & ((part.data & 0xC0) != 0x80))
        symbols = part.per_document(_SYMBOL[part.data])
        hashes = part.hashes(starts, ends)
        parts.append(
            (counts, characters, symbols, _duplicate_lines(part, starts), _repeated(hashes, counts))
        )
    if not parts:
        return {name: np.zeros(0, np.int64) for name in MEASURES}
    return {name: np.concatenate(values) for name, values in zip(MEASURES, zip(*parts))}


def _duplicate_lines(part: arrays.Slice, word_starts: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of the same text."""
    starts, ends, counts = part.spans(part.data != 10)
    has_word = np.searchsorted(word_starts, ends) > np.searchsorted(word_starts, starts)
    document = arrays.owners(counts)[has_word]
    hashes = part.hashes(starts, ends)[has_word]
    order = np.lexsort((hashes, document))
    document, hashes = document[order], hashes[order]
    again = (document[1:] == document[:-1]) & (hashes[1:] == hashes[:-1])
    return np.bincount(document[1:][again], minlength=part.n)


def _repeated(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Words covered by 5-word windows that occur at least twice in their text."""
    window, first = arrays.windows(hashes, counts, WINDOW)
    document = arrays.owners(counts)
    key = arrays.mix(window + document[first].astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    order = np.argsort(key)
    key = key[order]
    same = key[1:] == key[:-1]
    twice = np.zeros(len(key), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    begin = first[order[twice]]
    edge = np.zeros(len(hashes) + 1, dtype=np.int64)
    np.add.at(edge, begin, 1)
    np.add.at(edge, begin + WINDOW, -1)
    return np.bincount(document[np.cumsum(edge[:-1]) > 0], minlength=len(counts))


def measured(docs: DataFrame) -> DataFrame:
    """The documents with the five measures beside them; one pass, no shuffle."""
    kept = [f for f in docs.schema.fields if f.name not in MEASURES]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, *(T.StructField(m, T.LongType()) for m in MEASURES)])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = measure(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), *(pa.array(found[m], pa.int64()) for m in MEASURES)],
                names=[*names, *MEASURES],
            )

    return docs.select(*names).mapInArrow(add, schema)


def rules() -> dict[str, F.Column]:
    """Each rule as a condition that is true where a document fails it."""
    words = F.col("n_words")
    return {
        "short": words < 10,
        "repeated": 100 * F.col("n_repeat_words") > 20 * words,
        "symbols": 100 * F.col("n_symbols") > 10 * F.greatest(F.col("word_chars"), F.lit(1)),
        "lines": 100 * F.col("n_dup_lines") > 30 * words,
    }


def host_verdicts(docs: DataFrame, rule: HostRule = HostRule()) -> DataFrame:
    """One row per host: documents, failures and shrunk rate of each rule, refused or not.

    `docs` carries `source` and the measures. Failures are summed before the shuffle, so a
    host with a third of all documents costs no more than any other.
    """
    failed = rules()
    hosts = docs.groupBy(F.col("source").alias("host")).agg(
        F.count(F.lit(1)).alias("n_docs"),
        *(F.count_if(cond).alias(f"n_{name}") for name, cond in failed.items()),
    )
    hosts = materialised(hosts, "hosts")
    enough = F.col("n_docs") >= rule.min_documents
    rate = {name: F.col(f"n_{name}") / F.col("n_docs") for name in failed}
    # One row: mean and variance of the rates over the hosts, and the mean of 1/documents,
    # from which the variance between hosts (without that of sampling) follows.
    prior = hosts.where(enough).agg(
        *(F.avg(r).alias(f"mean_{name}") for name, r in rate.items()),
        *(F.var_samp(r).alias(f"var_{name}") for name, r in rate.items()),
        F.avg(1 / F.col("n_docs")).alias("sampling"),
    )
    out = hosts.join(F.broadcast(prior))  # one row by construction
    refused = F.lit(False)
    for name in failed:
        mean = F.least(F.greatest(F.coalesce(f"mean_{name}", F.lit(0.0)), F.lit(1e-4)), F.lit(1 - 1e-4))
        spread = mean * (1 - mean)
        between = F.greatest(
            F.coalesce(f"var_{name}", F.lit(0.0)) - spread * F.coalesce("sampling", F.lit(0.0)),
            spread / 1000,
        )
        strength = F.greatest(spread / between - 1, F.lit(1.0))
        shrunk = (F.col(f"n_{name}") + mean * strength) / (F.col("n_docs") + strength)
        out = out.withColumn(f"rate_{name}", shrunk)
        refused = refused | (F.col(f"rate_{name}") > rule.limit)
    shown = ["host", "n_docs", *(f"n_{n}" for n in failed), *(f"rate_{n}" for n in failed)]
    return out.select(*shown, refused.alias("host_refused"))


def judged(docs: DataFrame, rule: HostRule = HostRule()) -> DataFrame:
    """The documents with measures, `base_failed`, `host_refused` and `kept`.

    The measures are taken twice, once for the hosts and once for the documents: that costs
    less than moving the texts. The table of refused hosts is written first, so the planner
    knows its size and broadcasts it only if it is small.
    """
    verdicts = host_verdicts(measured(docs.select("source", "text")).drop("text"), rule)
    refused = materialised(verdicts.where("host_refused").select("host"), "refused-hosts")
    failed = rules()
    base = failed["short"] | failed["repeated"]
    refused = refused.withColumn("host_refused", F.lit(True))
    taken = [c for c in ("base_failed", "kept", "host", "host_refused") if c in docs.columns]
    rows = measured(docs.drop(*taken))
    out = rows.join(refused, rows["source"].eqNullSafe(refused["host"]), "left").drop("host")
    return out.withColumns(
        {
            "base_failed": base,
            "host_refused": F.coalesce("host_refused", F.lit(False)),
            "kept": ~base & ~F.coalesce("host_refused", F.lit(False)),
        }
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return judged(docs).select("doc_id", *MEASURES, "base_failed", "kept", "host_refused")
