"""Quality classifier by language-model perplexity (operator 3).

A modified Kneser-Ney model of byte 5-grams (see `kneser_ney`) is counted from the trusted
documents: those labelled as good and not toxic. Counts are sharded; documents are packed
into blocks, each block asks the shards for the probabilities of its distinct 5-grams, and
the answers meet the block again to give every document its perplexity. Neither the model
nor the answers ever meet in one place, and both grow with the corpus.

A fifth of the trusted documents takes no part in the counts. Quantiles of their log
perplexity, language by language, set the limits: a document is rejected if its own is above
the upper quantile by more than MARGIN times the distance from the median, plus an allowance
for short texts, whose mean scatters more.

A language with fewer than LEAST_TRUSTED of these documents keeps its own median, but takes
at least the spread of the documents of all languages about their medians, widened as its own
documents get fewer. The level of other languages says nothing about it.

Defined cases: a text with fewer than five bytes, or a null one, has no perplexity and is
kept; so are the documents of a language without any document for the limits (its threshold
is null), or with too few of them where there are not LEAST_SPREAD in all to take a spread
from; a null language is a language of its own;
repeated rows are judged alike; an empty table gives an empty result; clashing columns of
the input are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relaymill.llm import arrays, kneser_ney
from relaymill.llm.kneser_ney import ORDER
from relaymill.llm.tables import materialised, table

BLOCK_BYTES = 6 << 20
SHARD_GRAMS = 500_000
LEAST_SHARDS = 64
SHARD_BYTES = 64 << 20
QUANTILE = 0.95
MARGIN = 6.0
ALLOWANCE = 8.0
LEAST_TRUSTED = 20
LEAST_SPREAD = 10
BROADCAST_ROWS = 1_000_000

ADDED = ("n_scored", "log_perplexity", "perplexity", "threshold", "kept")
BLOCKS = "block string, keys binary, lengths binary, data binary"


def row_key() -> F.Column:
    return F.xxhash64("doc_id", "lang", "text")


def checked_join(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """A join that broadcasts the right side only if it has been counted and is small."""
    small = right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return left.join(F.broadcast(right) if small else right, on, how)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of trusted documents, and whether they are kept apart for the limits."""
    ids = labels.where("quality = 1 and toxic = 0 and doc_id is not null").select("doc_id").distinct()
    apart = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return materialised(ids.withColumn("apart", apart), "trusted")


class Model:
    """Counts to be sharded, their number, and the few numbers that every shard needs."""

    def __init__(self, counts: DataFrame, grams: int, cuts: dict[int, tuple], short: np.ndarray):
        self.counts, self.grams, self.cuts, self.short = counts, grams, cuts, short

    def shards_for(self, docs: DataFrame) -> int:
        """As many as keep both the counts and the questions of a shard small."""
        size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
        return max(LEAST_SHARDS, self.grams // SHARD_GRAMS, size // SHARD_BYTES)


def counted(texts: DataFrame) -> Model:
    """The model of all these texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = kneser_ney.Distinct()
        for batch in batches:
            for _, _, part in arrays.slices(batch.column("text")):
                found.add(kneser_ney.codes(part)[0])
        grams, counts = found.merge()
        for at in range(0, len(grams), 100_000):
            part = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(grams[part]), pa.array(counts[part])], names=["gram", "n"]
            )

    rows = texts.select("text").mapInArrow(count, "gram long, n long")
    level = materialised(rows.groupBy("gram").agg(F.sum("n").alias("n")), f"grams-{ORDER}")
    levels = {ORDER: level}
    for order in range(ORDER - 1, 0, -1):
        # how many different n-grams end in this one
        suffix = F.col("gram").bitwiseAND(F.lit((1 << (8 * order)) - 1)).alias("gram")
        level = materialised(level.groupBy(suffix).agg(F.count(F.lit(1)).alias("n")), f"grams-{order}")
        levels[order] = level
    cuts = {}
    for order, level in levels.items():
        few = level.agg(*(F.count_if(F.col("n") == k).alias(f"n{k}") for k in (1, 2, 3, 4))).first()
        cuts[order] = kneser_ney.discounts(*few)
    pairs = levels[2].collect()  # 65,536 rows at most
    unigrams = np.zeros(256, dtype=np.int64)
    for row in levels[1].collect():  # 256 rows at most
        unigrams[row.gram] = row.n
    short = kneser_ney.short_probabilities(
        np.array([r.gram for r in pairs], dtype=np.int64), np.array([r.n for r in pairs], dtype=np.int64), unigrams, cuts[1], cuts[2]
    )
    counts = None
    for order in range(3, ORDER + 1):
        rows = levels[order].withColumn("order", F.lit(order))
        counts = rows if counts is None else counts.unionByName(rows)
    return Model(counts, counts.count(), cuts, short)


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes, bytes, bytes]]:
    """The documents of a partition in blocks: name, row keys, lengths and bytes.

    A block is named by its content, so that it has the same name whenever it is made.
    """
    held: list[tuple] = []
    size = 0

    def closed() -> tuple[str, bytes, bytes, bytes]:
        keys, lengths, data = (b"".join(h[k] for h in held) for k in range(3))
        return hashlib.md5(keys + data).hexdigest(), keys, lengths, data

    for batch in batches:
        keys = batch.column("key").to_numpy()
        for begin, end, part in arrays.slices(batch.column("text")):
            lengths = np.diff(part.offsets).astype(np.int64)
            held.append((keys[begin:end].tobytes(), lengths.tobytes(), part.data.tobytes()))
            size += len(part.data)
            if size >= BLOCK_BYTES:
                yield closed()
                held, size = [], 0
    if held:
        yield closed()


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(row_key().alias("key"), "text")


def _blocks(docs: DataFrame) -> DataFrame:
    """The blocks with their bytes compressed."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, keys, lengths, data in _held(batches):
            parts = (keys, lengths, zstandard.compress(data, 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array([name]), *(pa.array([part], pa.binary()) for part in parts)],
                names=["block", "keys", "lengths", "data"],
            )

    return _keyed(docs).mapInArrow(pack, BLOCKS)


def _opened(lengths: bytes, data: bytes) -> Iterator[arrays.Slice]:
    """The documents of a block in slices."""
    offsets = np.concatenate(([0], np.cumsum(np.frombuffer(lengths, dtype=np.int64))))
    buffers = [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)]
    whole = pa.Array.from_buffers(pa.large_utf8(), len(offsets) - 1, buffers)
    for _, _, part in arrays.slices(whole):
        yield part


def _questions(docs: DataFrame, shards: int) -> DataFrame:
    """The distinct n-grams of each block, one row for each shard that knows of them."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, _, lengths, data in _held(batches):
            found = kneser_ney.Distinct()
            for part in _opened(lengths, data):
                found.add(kneser_ney.codes(part)[0])
            grams, _ = found.merge()
            shard = kneser_ney.shard_of(grams, shards)
            rows = [(s, grams[shard == s]) for s in np.unique(shard).tolist()]
            if rows:
                packed = [zstandard.compress(np.diff(g, prepend=0).tobytes(), 3) for _, g in rows]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name] * len(rows)),
                        pa.array([s for s, _ in rows], pa.int64()),
                        pa.array(packed, pa.binary()),
                    ],
                    names=["block", "shard", "grams"],
                )

    return _keyed(docs).mapInArrow(ask, "block string, shard long, grams binary")


def _grams(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.decompress(packed), dtype=np.int64))


def _answers(questions: DataFrame, model: Model, shards: int) -> DataFrame:
    """Log probabilities of the n-grams asked for; each shard is joined with its questions."""
    cuts, short = model.cuts, model.short

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = kneser_ney.shard_of(batch.column("gram").to_numpy(), shards)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("gram", "n", "order")), pa.array(shard)], names=["gram", "n", "order", "shard"]
            )

    known = model.counts.mapInArrow(label, "gram long, n long, order int, shard long")

    def answer(asked: pa.Table, counts: pa.Table) -> pa.Table:
        gram, n, order = (counts.column(c).to_numpy() for c in ("gram", "n", "order"))
        rows = {k: (gram[order == k], n[order == k]) for k in range(3, ORDER + 1)}
        shard = kneser_ney.Shard(rows, cuts, short)
        found = [
            np.log(shard.probability(_grams(g))).astype(np.float32).tobytes() for g in asked.column("grams").to_pylist()
        ]
        return pa.table(
            {"block": asked.column("block"), "grams": asked.column("grams"), "logs": pa.array(found, pa.binary())}
        )

    both = questions.groupBy("shard").cogroup(known.groupBy("shard"))
    return both.applyInArrow(answer, "block string, grams binary, logs binary")


def _scores(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """(key, n_scored, log_perplexity) of each document; the blocks meet their answers."""

    def score(block: pa.Table, known: pa.Table) -> pa.Table:
        keys, counts, sums = [], [], []
        if known.num_rows:
            grams = np.concatenate([_grams(g) for g in known.column("grams").to_pylist()])
            logs = np.concatenate([np.frombuffer(x, dtype=np.float32) for x in known.column("logs").to_pylist()])
            order = np.argsort(grams)
            grams, logs = grams[order], logs[order].astype(np.float64)
        for key, lengths, data in zip(*(block.column(c).to_pylist() for c in ("keys", "lengths", "data"))):
            keys.append(np.frombuffer(key, dtype=np.int64))
            for part in _opened(lengths, zstandard.decompress(data)):
                found, number = kneser_ney.codes(part)
                counts.append(number)
                total = np.zeros(len(found) + 1)
                if len(found):
                    at = np.minimum(np.searchsorted(grams, found), len(grams) - 1)
                    if not (grams[at] == found).all():
                        raise RuntimeError("a block has changed between asking and scoring")
                    np.cumsum(logs[at], out=total[1:])
                ends = np.cumsum(number)
                sums.append(total[ends] - total[ends - number])
        number = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        total = np.concatenate(sums) if sums else np.zeros(0)
        mean = pa.array(-total / np.maximum(number, 1), mask=number == 0)
        key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        return pa.table({"key": pa.array(key), "n_scored": pa.array(number), "log_perplexity": mean})

    both = blocks.groupBy("block").cogroup(answers.groupBy("block"))
    return both.applyInArrow(score, "key long, n_scored long, log_perplexity double")


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """Row keys with the number of scored positions and the mean log perplexity of each."""
    shards = model.shards_for(docs)
    answers = materialised(_answers(_questions(docs, shards), model, shards), "answers")
    return materialised(_scores(_blocks(docs), answers).dropDuplicates(["key"]), "scores")


def _language() -> F.Column:
    """The language as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))


def limits(scores: DataFrame) -> DataFrame:
    """Median and upper quantile of the log perplexity: (language, middle, upper).

    `scores` are those of trusted documents that took no part in the counts.
    """
    rows = scores.where("log_perplexity is not null").select(_language().alias("language"), "log_perplexity")
    own = materialised(
        rows.groupBy("language").agg(
            F.percentile_approx("log_perplexity", 0.5, 100_000).alias("middle"),
            F.percentile_approx("log_perplexity", QUANTILE, 100_000).alias("upper"),
            F.count(F.lit(1)).alias("n"),
        ),
        "own-limits",
    )
    apart = F.percentile_approx(F.col("log_perplexity") - F.col("middle"), QUANTILE, 100_000)
    free = F.count(F.lit(1)) - F.sum(1 / F.col("n"))  # less one for each language
    common = checked_join(rows, own, ["language"], "inner").agg(apart.alias("spread"), free.alias("free"))
    spread = F.greatest(F.col("upper") - F.col("middle"), "spread") * (1 + 4 / F.col("n"))
    upper = F.when(F.col("n") >= LEAST_TRUSTED, F.col("upper")).when(
        F.round("free") >= LEAST_SPREAD, F.col("middle") + spread
    )
    return own.join(F.broadcast(common)).select("language", "middle", upper.alias("upper"))  # one row


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, lang, n_scored, log_perplexity, perplexity, threshold, kept) for each document."""
    trusted = trusted_ids(labels)
    docs = docs.select("doc_id", "lang", "text")
    training = checked_join(docs, trusted.where("not apart").select("doc_id"), ["doc_id"], "left_semi")
    scores = scored(docs, counted(training))
    rows = docs.select(row_key().alias("key"), "doc_id", "lang")
    rows = materialised(rows.join(scores, "key", "left"), "scored-rows")
    apart = checked_join(rows, trusted.where("apart").select("doc_id"), ["doc_id"], "left_semi")
    bounds = materialised(limits(apart), "limits")
    rows = checked_join(rows.withColumn("language", _language()), bounds, ["language"], "left")
    middle, upper = F.col("middle"), F.col("upper")
    allowed = ALLOWANCE / F.sqrt(F.greatest("n_scored", F.lit(1)))
    threshold = upper + MARGIN * (upper - middle) + allowed
    return rows.select(
        "key",
        "doc_id",
        "lang",
        F.coalesce("n_scored", F.lit(0)).alias("n_scored"),
        "log_perplexity",
        F.exp("log_perplexity").alias("perplexity"),
        F.exp(threshold).alias("threshold"),
        F.coalesce(F.col("log_perplexity") <= threshold, F.lit(True)).alias("kept"),
    )


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not rejected, with all their columns."""
    good = classified(docs, labels).where("kept").select("key").distinct()
    return docs.withColumn("key", row_key()).join(good, "key", "left_semi").drop("key")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.drop("key", "log_perplexity")
