"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are present or absent: words, their first letters (for languages that compound), pairs
of neighbours, and pairs with one word between. The model is fitted on a bounded sample of labelled
rows, in one pass after another over the sample: each coordinate has its own learning rate, and the L1 term keeps all but a few weights at exactly
zero. Only the weights that are left are sent to the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import row_of, slices, spread, text_of

#: First letters of a word that are a feature of their own.
PREFIX = 4
#: A text is toxic from this score on.
CUT = 0.7


@dataclass(frozen=True)
class FtrlSettings:
    """``bits``: hashed coordinates are ``2 ** bits``. ``sample_rows``: the largest number of labelled rows of each class that are learnt from.

    ``sample_features``: of a longer text that is learnt from, as many coordinates, by a hash of the coordinate.
    """

    bits: int = 18
    sample_rows: int = 2_500
    sample_features: int = 20_000
    epochs: int = 6
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 6.0
    l2: float = 0.0


def features(texts, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of all texts (an Arrow array) and the text of each; a text has each coordinate once, in order."""
    from .words import hash_words, mix, seeded, split_words

    words, of = split_words(texts, letters_only=True)
    h, head = hash_words(words, PREFIX)
    found, texts_of = [mix(h ^ seeded(10)), mix(head ^ seeded(13))], [of, of]
    for gap in (1, 2):
        if len(h) > gap:
            pair = mix(h[:-gap] * seeded(11, gap) + (h[gap:] ^ seeded(12, gap)))
            inside = of[:-gap] == of[gap:]
            found.append(pair[inside])
            texts_of.append(of[:-gap][inside])
    at = (np.concatenate(found) >> np.uint64(64 - bits)).astype(np.int64)
    both = np.unique(np.concatenate(texts_of) << bits | at)
    return both & ((1 << bits) - 1), both >> bits


def fit_ftrl(rows: list[np.ndarray], labels: np.ndarray, settings: FtrlSettings) -> tuple[np.ndarray, float]:
    """Weights by coordinate and the intercept, which has no L1 term. ``rows``: coordinates of each text, in an order that is kept."""
    size = 1 << settings.bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    l1 = np.full(size + 1, settings.l1)
    l1[size] = 0.0

    def weights(at):
        rate = (settings.beta + np.sqrt(n[at])) / settings.alpha + settings.l2
        return np.where(np.abs(z[at]) <= l1[at], 0.0, -(z[at] - np.sign(z[at]) * l1[at]) / rate)

    rng = np.random.default_rng(7)
    for _ in range(settings.epochs):
        for i in rng.permutation(len(rows)):
            at = np.append(rows[i], size)
            w = weights(at)
            gap = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - labels[i]
            z[at] += gap - (np.sqrt(n[at] + gap * gap) - np.sqrt(n[at])) / settings.alpha * w
            n[at] += gap * gap
    w = weights(np.arange(size + 1))
    return w[:size], float(w[size])


def fit_toxicity(docs: DataFrame, labels: DataFrame, learn: Column, settings: FtrlSettings = FtrlSettings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[np.ndarray, np.ndarray, float]:
    """Coordinates with a weight, in order, their weights, and the intercept.

    ``learn`` is a condition on ``id``. Of the labelled rows that it holds for, each class gives
    at most ``sample_rows``, by a hash of the id: that bounds what the driver is sent, along with
    ``sample_features``. Rows with a null label or id are not learnt from, nor are ids that are
    labelled both ways. Texts that repeat an id are learnt from each. Without rows of both classes
    the score is constant.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("id is not null").filter(learn).filter("label in (0, 1)")
    known = known.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("other")).filter("label = other").drop("other")
    parts = [known.filter(F.col("label") == y).orderBy(F.xxhash64("id"), "id").limit(settings.sample_rows) for y in (0, 1)]
    chosen = {r.id: r.label for part in parts for r in part.collect()}
    if len(set(chosen.values())) < 2:
        share = sum(chosen.values()) / len(chosen) if chosen else 0.0
        return np.zeros(0, np.int64), np.zeros(0), float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    wanted = docs.sparkSession.createDataFrame([(k,) for k in chosen], T.StructType([T.StructField("id", labels.schema[id_col].dataType)]))
    texts = texts.join(F.broadcast(wanted), "id", "left_semi")
    bits = settings.bits

    def run(batches):
        import pyarrow as pa

        from .words import mix

        for batch in batches:
            for part in slices(batch, 1):
                at, of = features(part.column(1), bits)
                own = np.bincount(of, minlength=part.num_rows)
                if own.max(initial=0) > settings.sample_features:
                    order = np.lexsort((mix(at.astype(np.uint64)), of))
                    nth = np.arange(len(of)) - np.repeat(np.cumsum(own) - own, own)
                    chosen = np.sort(order[nth < settings.sample_features])
                    at, of = at[chosen], of[chosen]
                ends = np.searchsorted(of, np.arange(part.num_rows + 1))
                yield pa.record_batch([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at, pa.int32()))], ["id", "at"])

    got = texts.mapInArrow(run, T.StructType([texts.schema["id"], T.StructField("at", T.ArrayType(T.IntegerType()))])).orderBy("id").toArrow()
    column = got.column("at").combine_chunks()
    ends, flat = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]), column.flatten().to_numpy()
    rows = [flat[a:b].astype(np.int64) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    y = np.array([chosen[i] for i in got.column("id").to_pylist()], np.float64)
    weights, intercept = fit_ftrl(rows, y, settings)
    at = np.flatnonzero(weights)
    return at, weights[at], intercept


def _scored(rows: DataFrame, model: tuple[np.ndarray, np.ndarray, float], settings: FtrlSettings) -> DataFrame:
    """``rows``, whose last column is the text, with ``score`` in its place."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    bits = settings.bits

    def run(batches):
        import pyarrow as pa

        at, weights, intercept = sent.value
        full = np.zeros(1 << bits)
        full[at] = weights
        for batch in batches:
            last = batch.num_columns - 1
            for part in slices(batch, last):
                x, of = features(part.column(last), bits)
                total = np.bincount(of, weights=full[x], minlength=part.num_rows) + intercept
                score = 1.0 / (1.0 + np.exp(-np.clip(total, -35, 35)))
                yield pa.RecordBatch.from_arrays([*part.columns[:last], pa.array(score)], [*part.schema.names[:last], "score"])

    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("score", T.DoubleType())])
    return spread(rows).mapInArrow(run, schema)


def score_toxicity(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], settings: FtrlSettings = FtrlSettings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``id_col, score`` (0 to 1), ``predicted`` (1 from ``CUT`` on).

    Whole texts are scored and nothing else is; a null or empty text gets the score of no
    features. All rows stay, repeated ones and null ids too. Other columns are not read, whatever
    their names. No rows give no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return _scored(rows, model, settings).select(F.col("id").alias(id_col), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def drop_rejected(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], settings: FtrlSettings = FtrlSettings(), text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with a score below ``CUT``, with all their columns, whatever their names; odd rows as in ``score_toxicity``."""
    rows = docs.select(row_of(docs).alias("row"), text_of(text_col).alias("text"))
    return _scored(rows, model, settings).filter(F.col("score") < CUT).select("row.*")


def toxicity_scores(docs: DataFrame, labels: DataFrame, settings: FtrlSettings = FtrlSettings(), modulus: int = 3, remainder: int = 1) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row; labels of held-out ids are not learnt from. Null ids are not held out."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))
    model = fit_toxicity(docs, labels, F.crc32(F.col("id").cast("string").cast("binary")) % modulus != remainder, settings)
    return score_toxicity(docs, model, settings).select("doc_id", held_out.alias("held_out"), "score", "predicted")
