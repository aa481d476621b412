"""Toxicity classifier with a counterfactual penalty: swapping identity terms must not change a text's score.

A logistic model over distinct hashed words and word beginnings of whole texts. For each labelled text with identity terms, a second
version swaps each of them for another term of its kind; the fit adds ``PENALTY`` times the squared change of the
score over such pairs, so neutral mentions of groups don't raise a score. All features of the fitted texts have a weight; what a
feature tells by itself sets how much the ridge bears on it. A first fit leaves a fifth of the rows out, by which the decision is placed
and scaled, since toxic texts are few.

The fit reads ``SAMPLE_ROWS`` labelled rows at most (those with the smallest hash of doc_id), and so many of these that they have
``SAMPLE_FEATURES`` features at most; hashed pairs of these go to the driver. Every text is scored in numpy batches with broadcast weights of fixed size. Only the text enters a score.

Cases: a null or empty text has the score of a text without features. Without any label of a class, every score is the share
of toxic labels (0 without labels); with so few that none is set apart, or one class only, the decision stays where the fit put it. Null labels are left
out; a doc_id with several labels has the smallest, and of rows with the same doc_id the smallest text is fitted.
Texts of any length are read whole; repeated rows are scored alike, null doc_ids too; an empty table gives an empty one. Other columns are carried along by ``score``, but
for those named like its own two.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crossloom.llm._columns import kept
from crossloom.llm._labelled import SAMPLE_ROWS, Sparse, distinct_per_text, gathered, minimise, sample, word_features
from crossloom.runtime import materialise, prepare

BITS = 18
KINDS = ("word", "prefix4", "prefix5")
RIDGE = 1.0
PENALTY = 5.0
#: What a feature's strength is divided by, and the least strength: no feature is without weight.
UNIT, LEAST = 4.0, 0.05

#: Identity terms by kind; a term is swapped for the next one of its kind.
IDENTITY_TERMS = {
    "religion": ("muslim", "christian", "jewish", "hindu", "buddhist", "catholic", "atheist", "sikh"),
    "religions": ("muslims", "christians", "jews", "hindus", "buddhists", "catholics", "atheists", "sikhs"),
    "gender": ("woman", "man", "girl", "boy"),
    "genders": ("women", "men", "girls", "boys"),
    "gendered": ("female", "male", "transgender", "nonbinary"),
    "orientation": ("gay", "lesbian", "straight", "bisexual", "queer", "heterosexual", "homosexual"),
    "origin": ("african", "asian", "european", "american", "mexican", "arab", "latino", "chinese", "german", "french", "spanish"),
    "colour": ("black", "white"),
    "age": ("old", "young"),
    "ability": ("deaf", "blind", "disabled", "autistic"),
    "french": ("femmes", "hommes", "musulmans", "chrétiens", "juifs"),
    "german": ("frauen", "männer", "muslime", "christen", "juden"),
    "spanish": ("mujeres", "hombres", "musulmanes", "cristianos", "judíos"),
}
_NEXT = {t: terms[(k + 1) % len(terms)] for terms in IDENTITY_TERMS.values() for k, t in enumerate(terms)}
_TERM = re.compile(r"\b(" + "|".join(sorted(_NEXT, key=len, reverse=True)) + r")\b", re.IGNORECASE)


def swapped(text: str) -> str:
    """The text with every identity term replaced by the next of its kind; upper case of the first letter stays."""

    def other(m: re.Match) -> str:
        new = _NEXT.get(m[0].lower(), m[0])
        return new.capitalize() if m[0][:1].isupper() else new

    return _TERM.sub(other, text)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0 (a null id: of the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def features(texts: DataFrame) -> DataFrame:
    """order (a hash of id and text), doc_id, feature, and other: the features of the swapped text where that differs, else null."""

    def lists(texts):
        parts = [pa.array([], pa.list_(pa.int32()))]
        for i, j, doc, feature, _ in word_features(pa.array(texts, pa.large_string()), BITS, KINDS):
            d, f, _ = distinct_per_text(doc, feature, BITS)
            parts.append(pa.ListArray.from_arrays(np.searchsorted(d, np.arange(j - i + 1)).astype(np.int32), pa.array(f.astype(np.int32))))
        return pa.concat_arrays(parts)

    def run(batches):
        for b in batches:
            own = [x or "" for x in b.column(2).to_pylist()]
            other = [swapped(x) for x in own]
            changed = np.array([x != y for x, y in zip(own, other, strict=True)], bool)
            place = pa.array(np.cumsum(changed) - 1, mask=~changed)
            swaps = lists([y for y, c in zip(other, changed, strict=True) if c]).take(place)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists(own), swaps], names=["order", "doc_id", "feature", "other"])

    rows = texts.select(F.xxhash64("doc_id", "text").alias("order"), F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, "order long, doc_id long, feature array<int>, other array<int>")


class ToxicityModel:
    def __init__(self, weights: np.ndarray, bias: float, slope: float = 1.0, shift: float = 0.0):
        self.weights, self.bias = (weights * slope).astype(np.float32), bias * slope + shift
        self.pairs = 0

    def scores(self, column: pa.Array) -> np.ndarray:
        parts = [np.zeros(0)]
        for i, j, doc, feature, _ in word_features(column, BITS, KINDS):
            d, f, _ = distinct_per_text(doc, feature, BITS)
            parts.append(np.bincount(d, self.weights[f].astype(np.float64), minlength=j - i) + self.bias)
        return 1 / (1 + np.exp(-np.clip(np.concatenate(parts), -500, 500)))


def strength(x: Sparse, toxic: np.ndarray, size: int) -> np.ndarray:
    """How far each feature's share of toxic texts is from the share of all, in standard deviations, as the scale of its values: the ridge
    bears less on features that tell much. No feature has none."""
    n1, n, p = np.bincount(x.feature, toxic[x.row], minlength=size), np.bincount(x.feature, minlength=size), toxic.mean()
    return np.maximum(np.abs(n1 - n * p) / np.sqrt(n * p * (1 - p) + 1), LEAST) / UNIT


def objective(x: Sparse, y: np.ndarray, a: Sparse, b: Sparse, size: int, ridge: float, penalty: float):
    """Value and gradient, by weights and bias, of the mean loss with its ridge and the squared changes of scores over the pairs."""

    def f(p):
        s = x.dot(p[:size]) + p[size]
        z = 1 / (1 + np.exp(-np.clip(s, -500, 500)))
        change = a.dot(p[:size]) - b.dot(p[:size])
        loss = -(y * np.log(z + 1e-12) + (1 - y) * np.log(1 - z + 1e-12)).sum() + ridge / 2 * (p[:size] @ p[:size]) + penalty / 2 * (change @ change)
        g = x.transpose_dot(z - y, size) + ridge * p[:size] + penalty * (a.transpose_dot(change, size) - b.transpose_dot(change, size))
        return loss / len(y), np.append(g, (z - y).sum()) / len(y)

    return f


def weigh(x: Sparse, y: np.ndarray, a: Sparse, b: Sparse, size: int, ridge: float, penalty: float) -> tuple[np.ndarray, float]:
    """Weights of all features, and the bias."""
    scale = strength(x, y, size)
    x, a, b = (Sparse(m.row, m.feature, m.value * scale[m.feature], m.rows) for m in (x, a, b))
    prior = float(np.log(y.mean() / (1 - y.mean())))
    p = minimise(objective(x, y, a, b, size, ridge, penalty), np.append(np.zeros(size), prior))
    return p[:size] * scale, float(p[size])


def fit_arrays(x: Sparse, toxic: np.ndarray, a: Sparse, b: Sparse, size: int, ridge: float = RIDGE, penalty: float = PENALTY) -> ToxicityModel:
    """x: labelled texts; a, b: pairs of a text and its swapped version. The decision is placed by a fit without a fifth of the rows; the
    weights are those of a fit of all rows."""
    if not len(toxic) or toxic.min() == toxic.max():
        share = float(toxic.mean()) if len(toxic) else 0.0
        return ToxicityModel(np.zeros(size), float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    y = toxic.astype(float)
    weights, bias = weigh(x, y, a, b, size, ridge, penalty)
    apart = np.arange(len(y)) % 5 == 4
    train, test = np.flatnonzero(~apart), np.flatnonzero(apart)
    if not len(test) or y[test].min() == y[test].max() or y[train].min() == y[train].max():
        return ToxicityModel(weights, bias)
    w, c = weigh(x.take(train), y[train], a, b, size, ridge, penalty)
    s, t = x.take(test).dot(w) + c, y[test]
    weight = np.where(t == 1, 0.5 / t.mean(), 0.5 / (1 - t.mean()))

    def place(q):
        z = 1 / (1 + np.exp(-np.clip(np.exp(q[0]) * s + q[1], -500, 500)))
        loss = -(weight * (t * np.log(z + 1e-12) + (1 - t) * np.log(1 - z + 1e-12))).sum() + 0.05 * (q[0] ** 2)
        d = weight * (z - t)
        return loss, np.array([(d * s).sum() * np.exp(q[0]) + 0.1 * q[0], d.sum()])

    q = minimise(place, np.zeros(2), rounds=100, tol=1e-10)
    return ToxicityModel(weights, bias, float(np.exp(q[0])), float(q[1]))


def _sparse(lists: pa.ChunkedArray) -> Sparse:
    count = pc.list_value_length(lists).to_numpy().astype(np.int64)
    flat = np.concatenate([np.zeros(0), *(np.asarray(k.flatten()) for k in lists.chunks)]).astype(np.int64)
    return Sparse(np.repeat(np.arange(len(count)), count), flat, np.ones(len(flat), np.float32), len(count))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, among: Column | None = None, penalty: float = PENALTY) -> ToxicityModel:
    """Fit on ``labels`` (doc_id, toxic) of ``docs``: at most ``rows`` of them, out of those that fit ``among``. The model's ``pairs`` says
    how many of the fitted texts hold identity terms."""
    prepare(docs.sparkSession)
    wanted = F.col("toxic").isNotNull() if among is None else F.col("toxic").isNotNull() & among
    chosen = materialise(sample(labels.select("doc_id", "toxic"), rows, wanted), "toxic-labels")
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    got = gathered(features(known).join(F.broadcast(chosen), "doc_id"), ["feature", "other"])
    toxic = got.column("toxic").to_numpy().astype(np.int64)
    swapped_rows = got.filter(got.column("other").is_valid())
    a, b = _sparse(swapped_rows.column("feature")), _sparse(swapped_rows.column("other"))
    model = fit_arrays(_sparse(got.column("feature")), toxic, a, b, 1 << BITS, penalty=penalty)
    model.pairs = a.rows
    return model


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and score, predicted, which replace columns of these names."""
    prepare(docs.sparkSession)
    keep = kept(docs, ["score", "predicted"])
    schema = T.StructType([*(docs.schema.fields[k] for k in keep), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            s = shared.value.scores(b.column(at))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=schema.names)

    return docs.mapInArrow(run, schema)


def crc_mod(doc_id: int | None, m: int) -> int:
    """The remainder that ``held_out`` looks at, in Python."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % m
