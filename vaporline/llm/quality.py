"""A quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled good; unlabelled are documents drawn from
the whole table, whatever their label. With class prior p, positive risk R+ and
negative risk R-, a linear model is fitted to the non-negative unbiased risk

    p R+(positives) + max(0, R-(unlabelled) - p R-(positives))

under logistic loss, so that its score estimates the chance that a document is good.
The prior is estimated from positives and unlabelled documents alone
(``estimated_prior``); labels of bad documents aren't used at all.

The model's inputs are rates of marks, digits, capitals, repeats and word shapes, and
of lower-cased words hashed to WORD_BUCKETS buckets.

The model is fitted on bounded samples (MOST_POSITIVES and MOST_UNLABELLED rows, the
smallest hashes of the id), of which only the features reach the driver; every
document's whole text is scored.

Defined results: a null or empty text has the features of no words and a score like
any other; a null id counts as the empty id, so it isn't held out; of several labels
of a document the smallest counts, null ones none; repeated rows give repeated
results; an empty table gives an empty result; without a trusted positive every
score is 0.5; columns other than id and text aren't read by ``score``.
"""

from __future__ import annotations

import operator
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaporline.llm.bpe_vocab import Bounded
from vaporline.llm.common import free_memory, fresh, ready, text_of

MOST_POSITIVES = 12_000
MOST_UNLABELLED = 12_000
THRESHOLD = 0.7
#: Remainder of the id's CRC-32 by FOLDS that is held out.
FOLDS, HELD_OUT = 4, 2

MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Words added to a text's length in its rates, which keeps short texts near 0.
SMOOTHING = 12
#: Words are hashed to so many buckets.
WORD_BUCKETS = 128

#: Of a word: its bucket.
BUCKETS = Bounded(lambda word: zlib.crc32(word.lower().encode()) % WORD_BUCKETS)


def features(text: str) -> list[float]:
    """Rates per word of each mark, digits, capitals, repeats, word shapes and hashed
    words; the text's length and its words' mean length."""
    words = text.split()
    n = len(words)
    over = n + SMOOTHING
    counts = [text.count(c) for c in MARKS]
    counts += [
        sum(map(text.count, "0123456789")),
        text.count("\n"),
        sum(map(str.isupper, words)),
        sum(map(str.istitle, words)),
        n - sum(map(str.isalnum, words)),
        sum(map(operator.eq, words, words[1:])),
        n - len(set(words)),
    ]
    long = sum(map(len, words)) / n if n else 5.0
    hashed = np.bincount(list(map(BUCKETS.__getitem__, words)), minlength=WORD_BUCKETS) if n else np.zeros(WORD_BUCKETS)
    return [*np.log1p(8.0 / over * np.concatenate([counts, hashed])).tolist(), np.log1p(n), min(long, 40.0)]


N_FEATURES = len(MARKS) + 9 + WORD_BUCKETS


@dataclass
class Model:
    """A linear model over standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        z = np.clip((rows - self.mean) / self.scale, -8, 8) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, *, steps: int = 600, rate: float = 0.05, penalty: float = 1e-3) -> Model:
    """Minimise the non-negative risk by full-batch Adam, from zero weights.

    Where the estimated negative risk is below 0, the step goes against it alone, as
    the method has it, so that the model doesn't fit what can't be.
    """
    if not len(positive) or not len(unlabelled):
        width = positive.shape[1]
        return Model(np.zeros(width), np.ones(width), np.zeros(width), 0.0, prior)
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 1e-3
    p, u = (np.hstack([np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1))]) for x in (positive, unlabelled))
    w, m, v = np.zeros(p.shape[1]), np.zeros(p.shape[1]), np.zeros(p.shape[1])
    for t in range(1, steps + 1):
        zp, zu = p @ w, u @ w
        sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        negative_step = u.T @ su / len(u) - prior * (p.T @ sp) / len(p)
        step = prior * (p.T @ (sp - 1)) / len(p) + negative_step if negative >= 0 else -negative_step
        step[:-1] += penalty * w[:-1]
        m, v = 0.9 * m + 0.1 * step, 0.999 * v + 0.001 * step**2
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(mean, scale, w[:-1], float(w[-1]), prior)


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of good documents among the unlabelled, by best-bin estimation.

    A model fitted to every other row of both samples scores the rest. If above some
    score there are good documents only, the share of the unlabelled that score so,
    divided by that of the positives, is the prior; bad ones among them make the
    quotient larger. It is taken at the score where its upper confidence bound
    (Dvoretzky-Kiefer-Wolfowitz, 90 %) is least. Samples of fewer than 2 rows: 0.5.
    """
    if min(len(positive), len(unlabelled)) < 2:
        return 0.5
    model = fit(positive[::2], unlabelled[::2], 0.5)
    p, u = np.sort(model.score(positive[1::2])), np.sort(model.score(unlabelled[1::2]))
    at = np.unique(p)
    of_p, of_u = (1 - np.searchsorted(x, at) / len(x) for x in (p, u))
    slack = sum(np.sqrt(np.log(4 / 0.1) / (2 * len(x))) for x in (p, u))
    best = np.argmin((of_u + slack) / of_p)
    # Kept off 0 and 1, where one of the risks would vanish.
    return float(np.clip(of_u[best] / of_p[best], 1 / (len(u) + 2), 1 - 1 / (len(u) + 2)))


def held_out(id_col: Column) -> Column:
    """Whether a row's label must not be learned from."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def drawn(ids: DataFrame, most: int) -> DataFrame:
    """At most ``most`` of the distinct ids, those of smallest hash: the same on every run."""
    return ids.distinct().orderBy(F.xxhash64(F.lit("quality"), "id"), "id").limit(most)


def sample(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> np.ndarray:
    """The features of the documents with these ids (broadcast: they are bounded), one
    row an id."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")).join(F.broadcast(ids), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([features(t.as_py()) for t in batch.column(1)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), found], ["id", "x"])

    found = rows.mapInArrow(run, "id long, x array<double>").groupBy("id").agg(F.min("x").alias("x")).orderBy("id").select("x").toArrow().column("x").combine_chunks()
    return found.values.to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES) if len(found) else np.zeros((0, N_FEATURES))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_positives: int = MOST_POSITIVES, most_unlabelled: int = MOST_UNLABELLED) -> Model:
    """Fit the model from labels (id_col, label_col) of rows that aren't held out."""
    ready(docs.sparkSession)
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    trusted = known.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(label_col).alias("label")).where("label = 1")
    positive = sample(docs, drawn(trusted.select("id"), most_positives), id_col, text_col)
    unlabelled = sample(docs, drawn(docs.select(F.col(id_col).cast("long").alias("id")).where("id IS NOT NULL"), most_unlabelled), id_col, text_col)
    return fit(positive, unlabelled, estimated_prior(positive, unlabelled))


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted. A map over partitions."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([features(t.as_py()) for t in batch.column(2)]).reshape(-1, N_FEATURES)
            got = model.score(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got), pa.array((got >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that the model predicts to be good, with all their columns."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.score(np.array([features(t) for t in texts]).reshape(-1, N_FEATURES)))
        BUCKETS.rest()
        free_memory()

    scored = F.pandas_udf(run, "double")
    (name,) = fresh(docs, "quality_score")
    return docs.withColumn(name, scored(text_of(text_col))).where(F.col(name) >= threshold).drop(name)
