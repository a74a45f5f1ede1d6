"""Language identification by a bidirectional gated recurrent network (operator 6).

The network reads bytes in windows, labels every position, and the mean over all positions
of a text gives its probabilities. It is trained on the driver from a bounded sample of the
labelled documents that are not held out; the whole table is labelled where it lies, in one
pass without a shuffle. `lang`, `source` and `doc_id` are never inputs of a prediction.

The sample is SAMPLE_DOCUMENTS segments of SEGMENT characters per language: a fixed-size
parameter, as the network has a few thousand weights.

Defined cases: a text that is null or has no letter is `und` with score 0; equal texts get
equal labels; with no labelled document at all everything is `und`; a null doc_id counts as
an empty text when it is decided what is held out; an empty table
gives an empty result; clashing columns of the input are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relaymill.llm import arrays, gated_net
from relaymill.llm.tables import table

SAMPLE_DOCUMENTS = 400
SEGMENT = 1024
UNKNOWN = "und"

_ASCII_LETTER = np.zeros(256, dtype=bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True
_LETTER = regex.compile(r"\p{L}")


def held_out() -> F.Column:
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.crc32(key.cast("binary")) % 5 == 0


def sample(docs: DataFrame, per_language: int = SAMPLE_DOCUMENTS) -> list[tuple[str, str]]:
    """(text, lang) of at most `per_language` documents of each language, chosen by a hash.

    The numbers per language set how much of each is let through, so that only the rows of
    the sample leave the scan.
    """
    usable = docs.where(~held_out() & F.col("lang").isNotNull() & (F.length("text") > 0))
    numbers = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not numbers:
        return []
    scale = 1 << 30
    bound = {lang: int(min(1.0, 1.2 * per_language / n) * scale) for lang, n in numbers.items()}
    bounds = F.create_map(*(F.lit(x) for pair in bound.items() for x in pair))
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(scale))
    start = F.pmod(F.xxhash64("text"), F.greatest(F.length("text") - SEGMENT, F.lit(1)))
    chosen = usable.where(draw < F.try_element_at(bounds, "lang")).select(
        "lang", F.substring("text", (start + 1).cast("int"), F.lit(SEGMENT)).alias("part"), draw.alias("draw")
    )
    rows = sorted(chosen.limit(2 * per_language * len(numbers)).collect(), key=lambda r: (r.lang, r.draw, r.part))
    taken: dict[str, list[str]] = {lang: [] for lang in sorted(numbers)}
    for row in rows:
        if len(taken[row.lang]) < per_language:
            taken[row.lang].append(row.part)
    return [(part, lang) for lang, parts in taken.items() for part in parts]


class Model:
    """Languages in order, and the weights."""

    def __init__(self, languages: list[str], weights: dict[str, np.ndarray]):
        self.languages, self.weights = languages, weights


def fitted(docs: DataFrame, per_language: int = SAMPLE_DOCUMENTS) -> Model | None:
    rows = sample(docs, per_language)
    languages = sorted({lang for _, lang in rows})
    if not languages:
        return None
    texts = [part.encode() for part, _ in rows]
    labels = [languages.index(lang) for _, lang in rows]
    return Model(languages, gated_net.train(texts, labels, len(languages)))


def labelled(docs: DataFrame, model: Model | None) -> DataFrame:
    """The documents with `lang_pred` and `score`."""
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = T.StructType(
        [*(docs.schema[c] for c in names), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    )
    languages, weights = (model.languages, model.weights) if model else ([], None)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[str] = []
            scores: list[float] = []
            text = batch.column("text")
            for begin, end, part in arrays.slices(text):
                lettered = part.per_document(_ASCII_LETTER[part.data]) > 0
                for i in np.flatnonzero(~lettered):
                    data = part.data[part.offsets[i] : part.offsets[i + 1]].tobytes()
                    lettered[i] = bool(_LETTER.search(data.decode()))
                if languages:
                    offsets = part.offsets
                    texts = [part.data[offsets[i] : offsets[i + 1]].tobytes() for i in range(part.n)]
                    shares = gated_net.pooled(weights, texts)
                    best = shares.argmax(axis=1)
                else:
                    lettered[:] = False
                for i in range(end - begin):
                    found.append(languages[best[i]] if lettered[i] else UNKNOWN)
                    scores.append(float(min(1.0, shares[i, best[i]])) if lettered[i] else 0.0)
            columns = [*(batch.column(n) for n in names), pa.array(found, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "lang_pred", "score"])

    return docs.select(*names).mapInArrow(label, schema)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = labelled(docs.select("doc_id", "text"), fitted(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
