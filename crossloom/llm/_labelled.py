"""A bounded sample of labelled rows, and features of whole texts for linear models."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossloom.llm._batches import SPACES, Words, chunks, mix

SAMPLE_ROWS = 6_000
SAMPLE_FEATURES = 30_000_000


def sample(labels: DataFrame, rows: int, where: Column | None = None) -> DataFrame:
    """``rows`` labelled documents at most, those with the smallest hash of their doc_id; repeated ids keep one label row (the
    smallest). The bound is the only limit: it says how many labelled rows the fit reads, whatever the corpus holds."""
    if where is not None:
        labels = labels.where(where)
    one = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*(F.min(c).alias(c) for c in labels.columns if c != "doc_id"))
    return one.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(rows)


def word_features(column: pa.Array, bits: int, kinds: tuple[str, ...]):
    """For each chunk of texts: (rows from, to, text index of each feature, hashed feature, count of words of each text).

    Kinds: word; prefix4, prefix5, prefix6 (first bytes of longer words); suffix3 (last bytes); twice (equals the word
    before it)."""
    mask = np.uint64((1 << bits) - 1)
    for i, j, data, offsets in chunks(column):
        w = Words(data, offsets, SPACES)
        docs, feats = [], []

        def add(doc, h, kind, docs=docs, feats=feats):
            docs.append(doc)
            feats.append((mix(h + np.uint64(kind * 0x9E3779B97F4A7C15 & 2**64 - 1)) & mask).astype(np.int64))

        size = w.end - w.start
        for k, kind in enumerate(kinds):
            if kind == "word":
                add(w.doc, w.hash, k)
            elif kind.startswith("prefix"):
                n = int(kind[6:])
                long = size > n
                add(w.doc[long], w.slices(w.start[long], w.start[long] + n), k)
            elif kind.startswith("suffix"):
                n = int(kind[6:])
                long = size > n
                add(w.doc[long], w.slices(w.end[long] - n, w.end[long]), k)
            elif kind == "twice" and len(w.hash):
                same = np.zeros(len(w.hash), bool)
                same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
                add(w.doc[same], np.zeros(same.sum(), np.uint64), k)
        yield i, j, np.concatenate(docs) if docs else np.zeros(0, np.int64), np.concatenate(feats) if feats else np.zeros(0, np.int64), w.count


def distinct_per_text(doc: np.ndarray, feature: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, feature, count), each pair once, sorted."""
    key, count = np.unique(doc.astype(np.int64) << bits | feature, return_counts=True)
    return key >> bits, key & ((1 << bits) - 1), count


def gathered(features: DataFrame, lists: list[str], most: int = SAMPLE_FEATURES) -> pa.Table:
    """The fitted rows on the driver, in an order that depends on ids and texts only. ``features`` has ``order`` (hashes), doc_id and
    list columns; beyond ``most`` list entries in all, rows at the end of the order are left out of the fit."""
    from crossloom.runtime import materialise

    held = materialise(features, "features")
    size = sum((F.coalesce(F.size(c), F.lit(0)) for c in lists), F.lit(0)).cast("long")
    sizes = held.select("order", "doc_id", size.alias("n")).toPandas()
    sizes = sizes.sort_values(["order", "doc_id"])
    if sizes["n"].sum() > most:
        last = sizes["order"][sizes["n"].cumsum() <= most].max()
        held = held.where(F.col("order") <= F.lit(int(last)) if last == last else F.lit(False))
    return held.toArrow().sort_by([("order", "ascending"), ("doc_id", "ascending")])


class Sparse:
    """Rows of (feature, value) pairs, for fits on the driver."""

    def __init__(self, row: np.ndarray, feature: np.ndarray, value: np.ndarray, rows: int):
        self.row, self.feature, self.value, self.rows = row, feature, value.astype(np.float64), rows

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.feature] * self.value, minlength=self.rows)

    def transpose_dot(self, g: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.feature, g[self.row] * self.value, minlength=size)

    def take(self, rows: np.ndarray) -> Sparse:
        place = np.full(self.rows, -1)
        place[rows] = np.arange(len(rows))
        ok = place[self.row] >= 0
        return Sparse(place[self.row[ok]], self.feature[ok], self.value[ok], len(rows))


def minimise(value_and_gradient, x: np.ndarray, rounds: int = 60, memory: int = 8, tol: float = 1e-6) -> np.ndarray:
    """L-BFGS with a backtracking line search."""
    f, g = value_and_gradient(x)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        q, alphas = g.copy(), []
        for s, y, r in reversed(steps):
            a = r * (s @ q)
            alphas.append(a)
            q -= a * y
        if steps:
            s, y, _ = steps[-1]
            q *= (s @ y) / (y @ y)
        else:
            q /= max(1.0, np.abs(g).sum())
        for (s, y, r), a in zip(steps, reversed(alphas), strict=True):
            q += s * (a - r * (y @ q))
        slope, t = -(g @ q), 1.0
        if slope >= 0:
            steps.clear()
            q, slope = g / max(1.0, np.abs(g).sum()), -(g @ g) / max(1.0, np.abs(g).sum())
        while True:
            new = x - t * q
            f2, g2 = value_and_gradient(new)
            if f2 <= f + 1e-4 * t * slope or t < 1e-8:
                break
            t /= 2
        s, y = new - x, g2 - g
        if s @ y > 1e-12:
            steps.append((s, y, 1 / (s @ y)))
            steps = steps[-memory:]
        done = abs(f - f2) <= tol * max(1.0, abs(f))
        x, f, g = new, f2, g2
        if done:
            break
    return x
