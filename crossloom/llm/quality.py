"""Quality classifier: ordinal regression with cumulative links on graded ratings.

Grades 0 < 1 < ... < K share one vector of weights over hashed text features; P(grade >= k) = sigmoid(w.x - t_k) with ordered
thresholds t_1 < ... < t_K. A document's score gives its expected grade and tail probabilities, and documents are selected by
a tail probability.

Features are shares of a whole text's words: words, their last three bytes, words that repeat the word before.
The fit reads ``SAMPLE_ROWS`` labelled rows at most (those with the smallest hash of doc_id), and so many of these that they have
``SAMPLE_FEATURES`` features at most; the features go to the driver, as hashed pairs. Every document is scored, in numpy batches, with broadcast weights of fixed size.

Cases: a null text is an empty one, without features: its score is the one of the thresholds alone. Grades that are null
are left out of the fit, and of rows with the same doc_id the smallest text is fitted; if there is one grade only, every document gets that grade with certainty, so labels of
low quality only select nothing. Without any grade the expected grade is 0, but every document is selected for a grade of 1: nothing is known against it. Repeated rows are scored alike; a null doc_id is scored too. Texts of any length are read whole. An empty table gives
an empty one. Other columns are carried along; ``score`` replaces those named like its own two, ``select`` keeps all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crossloom.llm._columns import kept, unused
from crossloom.llm._labelled import SAMPLE_ROWS, Sparse, distinct_per_text, gathered, minimise, sample, word_features
from crossloom.runtime import materialise, prepare

BITS = 16
KINDS = ("word", "suffix3", "twice")
RIDGE = 1.0
SCALE = 30.0


def _values(doc: np.ndarray, count: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Damped shares: a feature's square root of its share among a text's words."""
    return SCALE / 6 * np.sqrt(count / np.maximum(1, words[doc]))


def features(texts: DataFrame, bits: int = BITS) -> DataFrame:
    """doc_id, feature, value as arrays for each text."""

    def run(batches):
        for b in batches:
            for i, j, doc, feature, words in word_features(b.column(1), bits, KINDS):
                d, f, c = distinct_per_text(doc, feature, bits)
                ends = np.searchsorted(d, np.arange(j - i + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.ListArray.from_arrays(ends, pa.array(f.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(_values(d, c, words).astype(np.float32)))],
                    names=["doc_id", "feature", "value"],
                )

    return texts.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, feature array<int>, value array<float>")


class OrdinalModel:
    """Weights over hashed features and ordered thresholds. ``labelled``: whether it was fitted on any grade."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray, labelled: bool = True):
        self.weights, self.thresholds, self.labelled = weights.astype(np.float32), thresholds, labelled

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 .. K: a row for each score."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -500, 500)))

    def scores(self, column: pa.Array, bits: int = BITS) -> np.ndarray:
        parts = [np.zeros(0)]
        for i, j, doc, feature, words in word_features(column, bits, KINDS):
            d, f, c = distinct_per_text(doc, feature, bits)
            parts.append(np.bincount(d, self.weights[f] * _values(d, c, words), minlength=j - i))
        return np.concatenate(parts)


def objective(x: Sparse, grade: np.ndarray, size: int, ridge: float):
    """Value and gradient, by weights, first threshold and logarithms of gaps, of the mean loss with its ridge; and how such parameters are
    split into weights and thresholds."""
    n, top = len(grade), int(grade.max())

    def split(p):
        t = np.cumsum(np.concatenate([p[size : size + 1], np.exp(np.clip(p[size + 1 :], -20, 20))]))
        return p[:size], t

    def value(p):
        w, t = split(p)
        edges = np.concatenate([[-np.inf], t, [np.inf]])
        s = x.dot(w)
        sig = lambda z: np.where(np.isposinf(z), 1.0, 1 / (1 + np.exp(-np.clip(z, -500, 500))))
        low, high = sig(s - edges[grade]), np.where(grade == top, 0.0, sig(s - edges[np.minimum(grade + 1, top + 1)]))
        low = np.where(grade == 0, 1.0, low)
        p_own = np.maximum(low - high, 1e-12)
        d_low, d_high = np.where(grade == 0, 0.0, low * (1 - low)) / p_own, np.where(grade == top, 0.0, high * (1 - high)) / p_own
        g_s = -(d_low - d_high)
        g_t = np.bincount(grade, d_low, minlength=top + 1)[1:] - np.bincount(grade, d_high, minlength=top + 1)[:-1]
        back = np.cumsum(g_t[::-1])[::-1]
        g_p = np.concatenate([back[:1], back[1:] * np.exp(np.clip(p[size + 1 :], -20, 20))])
        return (-np.log(p_own).sum() + ridge / 2 * (w @ w)) / n, np.concatenate([x.transpose_dot(g_s, size) + ridge * w, g_p]) / n

    return value, split


def fit_arrays(x: Sparse, grade: np.ndarray, size: int, ridge: float = RIDGE) -> OrdinalModel:
    """Maximum likelihood with a ridge on the weights; thresholds are a first value and logarithms of gaps, so they stay ordered."""
    top = int(grade.max()) if len(grade) else 0
    if not len(grade) or grade.min() == top:
        return OrdinalModel(np.zeros(size), np.full(top, -np.inf), bool(len(grade)))
    present = np.array([(grade >= k).mean() for k in range(1, top + 1)]).clip(1e-6, 1 - 1e-6)
    start = -np.log(present / (1 - present))
    gaps = np.log(np.maximum(np.diff(start), 1e-2))
    value, split = objective(x, grade, size, ridge)
    best = minimise(value, np.concatenate([np.zeros(size), start[:1], gaps]), rounds=50)
    w, t = split(best)
    return OrdinalModel(w, t)


def fit(docs: DataFrame, grades: DataFrame, rows: int = SAMPLE_ROWS, bits: int = BITS) -> OrdinalModel:
    """Fit on ``grades`` (doc_id, grade) of ``docs``: at most ``rows`` of them."""
    prepare(docs.sparkSession)
    chosen = materialise(sample(grades.where("grade IS NOT NULL").select("doc_id", F.col("grade").cast("int").alias("grade")), rows), "graded")
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    found = features(known.select("doc_id", "text"), bits).join(F.broadcast(chosen), "doc_id")
    got = gathered(found.withColumn("order", F.xxhash64("doc_id")), ["feature"])
    count = pc.list_value_length(got.column("feature")).to_numpy().astype(np.int64)
    flat = lambda c, t: np.concatenate([np.asarray(k.flatten()) for k in got.column(c).chunks] or [np.zeros(0)]).astype(t)
    x = Sparse(np.repeat(np.arange(len(count)), count), flat("feature", np.int64), flat("value", np.float64), len(count))
    return fit_arrays(x, got.column("grade").to_numpy().astype(np.int64), 1 << bits)


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) from the 0/1 labels: 0 for low quality, 1 for good but toxic text, 2 for good text without toxic words."""
    good, toxic = F.col("quality") == 1, F.coalesce(F.col("toxic"), F.lit(0)) == 1
    return labels.where("quality IS NOT NULL").select("doc_id", F.when(~good, 0).when(toxic, 1).otherwise(2).alias("grade"))


def score(docs: DataFrame, model: OrdinalModel, text_col: str = "text", names: tuple[str, str] = ("expected_grade", "tails")) -> DataFrame:
    """All columns of ``docs``, and expected_grade and tails (P(grade >= k) for each k from 1); they replace columns of these names."""
    prepare(docs.sparkSession)
    keep = kept(docs, list(names))
    schema = T.StructType([*(docs.schema.fields[k] for k in keep), T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.ArrayType(T.DoubleType()))])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            t = shared.value.tails(shared.value.scores(b.column(at)))
            ends = np.arange(b.num_rows + 1, dtype=np.int32) * t.shape[1]
            cols = [*(b.column(k) for k in keep), pa.array(t.sum(1)), pa.ListArray.from_arrays(ends, pa.array(t.ravel()))]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return docs.mapInArrow(run, schema)


def tail(model: OrdinalModel, grade: int, tails: str = "tails") -> Column:
    """P(grade >= ``grade``) out of the column ``tails``: 0 for grades above all that were fitted. A model without any label knows nothing
    against a document: 1 for ``grade`` 1, 0 above."""
    if not model.labelled:
        return F.lit(float(grade <= 1))
    return F.element_at(tails, grade) if len(model.thresholds) >= grade else F.lit(0.0)


def select(docs: DataFrame, model: OrdinalModel, grade: int = 1, least: float = 0.5) -> DataFrame:
    """Rows of ``docs``, all columns, with P(grade >= ``grade``) of at least ``least``."""
    names = unused(docs, "expected_grade"), unused(docs, "tails")
    return score(docs, model, names=names).where(tail(model, grade, names[1]) >= least).select(docs.columns)


def select_labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labels of ``docs`` and keep what is probably of good quality; without any label everything stays, and with labels of low
    quality only nothing does."""
    model = fit(docs, graded(labels))
    return select(docs, model) if model.labelled else docs
