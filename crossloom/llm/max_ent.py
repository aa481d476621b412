"""LM scoring: a hashed maximum-entropy model over counted words.

P(word | history) = P(class | history) * P(word | class, history), both with the same features of the history: the word before, the
two words before, and the one before the last (a skip).

* The class part is a softmax over ``CLASSES`` classes. The most frequent words have classes of their own; any other word's
  class is a hash of its last two bytes, which tell languages and endings apart.
* The word part is a softmax over all outcomes of a class, from their add-one shares: the broadcast words, and hashed buckets of all
  others. A bucket's mass is shared out among its words by add-one counts. Counts are exact, over all training documents. The
  normaliser is exact: what outcomes without a weight add is known by class and part, the others are added one by one.

One model: every weight is one number, trained from all training tokens it has to do with, however these are dealt.

* The skip feature's weights (rows hashed to a table that grows up to ``SKIP_ROWS``; classes, and ``PARTS`` parts of a class) come from gradients
  that each task counts and Spark adds up. They are broadcast.
* Tokens are dealt to groups by the word before them, so the weights of the first two features are partitioned by it, and their number grows
  with the corpus. Where more than ``HOT_TOKENS`` tokens follow a word, they are dealt by the pair of words before; the counts of what
  follows the word, summed over all tasks, go to each of its groups, so its weights are the same in all of them.

Tokens are stored once, as ids of 32 bits, and go through in ``SLICES`` passes, so only a part of them is shuffled at once; ``TASK_GROUPS`` groups go to a task
together. Nothing depends on how the input or the shuffles are
partitioned, nor on the number of groups.

Training: updates by gradients over all training tokens, in blocks. The skip and the word before move together, from the prior (so
that only counts have to be summed over tasks; the skip makes ``SHARE`` of its step), then the two words before, given what these
explain. A class's weight moves by its gradient over its curvature and a ridge; a word's weight moves to where its gradient, with a ridge, is zero (iterative scaling).
The skip's parts of a class move as classes do. ``ROUNDS`` rounds. Equal (history, word) events are one row with a count. Scoring goes by the same rows.
Ridges were chosen on training documents alone (those with a remainder of 3 were left out to compare).

Counting: each task reduces its words before they are shuffled, so a word that makes up a third of all is one row a task.
Looking up: words with so high a count that at most ``TOP_WORDS`` words have it are broadcast (a bound that doesn't grow); a document's sums
over these are formed where its text is read. Of all others, (document, word) rows are joined with the counts and added up by
document. So neither texts nor the whole vocabulary are ever shuffled to one place.

Words are known by their 64-bit hash (see ``_batches``): of 10^8 distinct words two share one with a chance of 0.03 %.

Cases: a null text is an empty one: its only token is the end. Words of any length count. A null doc_id counts as the empty id and
is scored. Repeated rows count and are scored each. Without training documents N and V are 0 and every word has the probability of an unknown one.
Columns other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import gc
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossloom.llm._batches import Words, chunks, mix
from crossloom.runtime import materialise, partitions, prepare

CLASSES = 32
OWN = 12
TOP_WORDS = 200_000
SHARD_TOKENS = 100_000
GROUP_SHARDS = 4
SLICES = 4
TASK_GROUPS = 8
ROUNDS = 1
FLUSH_TOKENS = 1_000_000
#: Parts of a class that skip weights tell apart; at most so many buckets of rare words a class, and rows of skip weights.
PARTS = 8
BUCKETS = 4096
SKIP_ROWS = 1 << 16
BLOCKS = 64
#: Words that more tokens follow are spread over groups; their counts go along.
HOT_TOKENS = 400_000
EVENTS = 50_000
#: Ridges of the features' weights (and of words' weights), the part of its step that the skip makes beside the word before, and the largest step of a weight.
RIDGE = (2.0, 0.5, 1.0)
WORD_RIDGE = (0.3, 0.1)
SHARE = 0.3
LARGEST = 6.0
#: Rows of logits that are worked on at once: what is in hand stays in a core's cache.
ROWS = 512
END = np.uint64(0x5EED0FE4D)
RARE = 1 << 31


def training(doc_id: Column, modulus: int = 7, out: int = 2) -> Column:
    """Is the document learned from? crc32 of the id as text, modulo ``modulus``, isn't ``out``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus != out


class Tokens:
    """Words of a chunk of texts, each text's followed by one end: ``word`` (hash), ``tail`` (hash of the last two bytes),
    ``first``: index of each text's first token (and after the last), ``doc``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        w = Words(data, offsets)
        n, docs = len(w.hash), len(offsets) - 1
        at = np.arange(n) + w.doc
        self.first = w.first + np.arange(docs + 1)
        self.word = np.full(n + docs, END, np.uint64)
        self.word[at] = w.hash
        self.tail = np.zeros(n + docs, np.uint64)
        self.tail[at] = w.slices(np.maximum(w.start, w.end - 2), w.end)
        self.doc = np.repeat(np.arange(docs), w.count + 1)


def before(ids: np.ndarray, first: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each token the word before it and the one before that (the end, where the text begins). first: see ``Tokens``."""
    back1, back2 = np.full(len(ids), end, ids.dtype), np.full(len(ids), end, ids.dtype)
    back1[1:], back2[2:] = ids[:-1], ids[:-2]
    back1[first[:-1]] = end
    back2[first[:-1]] = end
    back2[np.minimum(first[:-1] + 1, first[1:] - 1)] = end
    return back1, back2


def _merge(word: list, tail: list, n: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    w, t, k = np.concatenate(word), np.concatenate(tail), np.concatenate(n)
    order = np.argsort(w, kind="stable")
    w, t, k = w[order], t[order], k[order]
    new = np.ones(len(w), bool)
    new[1:] = w[1:] != w[:-1]
    at = np.flatnonzero(new)
    return w[at], t[at], np.add.reduceat(k, at) if len(at) else k


def _tail_class(tail: np.ndarray) -> np.ndarray:
    return (OWN + mix(tail) % np.uint64(CLASSES - OWN)).astype(np.int8)


MERGE_ROWS = 1_500_000


def word_counts(docs: DataFrame) -> DataFrame:
    """word, cls, n: exact counts of the tokens of all training documents."""

    def run(batches):
        word, tail, n, rows = [], [], [], 0

        def out():
            w, t, k = _merge(word, tail, n)
            for i in range(0, len(w), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(w[i : i + 100_000].view(np.int64)), pa.array(t[i : i + 100_000]), pa.array(k[i : i + 100_000])], names=["word", "cls", "n"])

        for b in batches:
            for _, _, data, offsets in chunks(b.column(0)):
                t = Tokens(data, offsets)
                w, first, k = np.unique(t.word, return_index=True, return_counts=True)
                word.append(w)
                tail.append(_tail_class(t.tail[first]))
                n.append(k.astype(np.int64))
                rows += len(w)
                if rows > MERGE_ROWS:
                    w, c, k = _merge(word, tail, n)
                    word, tail, n, rows = [w], [c], [k], 0
                    if len(w) > MERGE_ROWS // 2:  # memory stays bounded
                        yield from out()
                        word, tail, n = [], [], []
        if word:
            yield from out()

    learn = docs.where(training(F.col("doc_id"))).select("text")
    return learn.mapInArrow(run, "word long, cls byte, n long").groupBy("word", "cls").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Totals, the frequent words with their counts, and the sizes of classes."""

    def __init__(self, word: np.ndarray, cls: np.ndarray, n: np.ndarray, n_class: np.ndarray, v_class: np.ndarray, rare: np.ndarray | None = None):
        """``rare``: counts and numbers of the words that aren't frequent, by class and bucket (2 x CLASSES x buckets)."""
        order = np.argsort(word)
        self.word, self.count = word[order], n[order]
        own = np.lexsort((word, -n))[:OWN]
        self.own_word = np.sort(word[own])
        self.tokens, self.distinct = int(n_class.sum()), int(v_class.sum())
        n_class, v_class = n_class.copy(), v_class.copy()
        np.subtract.at(n_class, cls[own], n[own])
        np.subtract.at(v_class, cls[own], 1)
        for k, w in enumerate(self.own_word):
            n_class[k], v_class[k] = n[word == w][0], 1
        self.n_class, self.v_class = n_class, v_class
        self._outcomes(cls[order], rare if rare is not None else np.zeros((2, CLASSES, 1), np.int64))

    def _outcomes(self, cls: np.ndarray, rare: np.ndarray) -> None:
        """Outcomes are numbered class by class: frequent words, then the class's buckets of other words. ``share``: an outcome's
        add-one share of its class, ``inside``: what a rare word's count + 1 is divided by within its bucket."""
        self.buckets = rare.shape[2]
        cls = cls.copy()
        cls[np.searchsorted(self.word, self.own_word)] = np.arange(len(self.own_word))
        k = np.arange(OWN, CLASSES)
        every = np.concatenate([cls, np.repeat(k, self.buckets)])
        mass = np.concatenate([self.count + 1.0, (rare.sum(0)[OWN:] + 1.0).ravel()])
        order = np.argsort(every, kind="stable")
        number = np.empty(len(every), np.int32)
        number[order] = np.arange(len(every))
        self.by_place, self.by_bucket = np.append(np.int32(-1), number[: len(cls)]), number[len(cls) :].reshape(len(k), self.buckets)
        self.cls_of, mass = every[order].astype(np.int8), mass[order]
        self.share = mass / np.bincount(self.cls_of, mass, minlength=CLASSES)[self.cls_of]
        self.inside = np.where(order < len(cls), 1.0, mass)
        self.part = (mix(np.arange(len(every)).astype(np.uint64)) % np.uint64(PARTS)).astype(np.int8)
        self.shares = np.bincount(self.cls_of.astype(np.int64) * PARTS + self.part, self.share, CLASSES * PARTS).reshape(CLASSES, PARTS)
        self.prior = np.log((self.n_class + 1) / (self.n_class.sum() + CLASSES))

    def ids(self, word: np.ndarray, cls: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Words as 32 bits: places, or of rare words the class and the first 26 bits of the hash."""
        out = place.astype(np.uint32)
        rare = np.flatnonzero(place == 0)
        out[rare] = np.uint32(RARE) | (cls[rare].astype(np.uint32) << np.uint32(26)) | (word[rare] >> np.uint64(38)).astype(np.uint32)
        return out

    def end(self) -> int:
        """The end's id."""
        word = np.array([END])
        return int(self.ids(word, _tail_class(np.zeros(1, np.uint64)), self.find(word))[0])

    def outcomes(self, ids: np.ndarray) -> np.ndarray:
        rare = np.flatnonzero(ids >= RARE)
        place = ids.astype(np.int64)
        place[rare] = 0
        out = self.by_place[place]
        cls = (ids[rare] >> np.uint32(26)).astype(np.int64) & 31
        out[rare] = self.by_bucket[np.maximum(cls, OWN) - OWN, (ids[rare] & np.uint32((1 << 26) - 1)) % np.uint32(self.buckets)]
        return out

    def times(self, ids: np.ndarray) -> np.ndarray:
        """Counts of frequent words, 0 for others."""
        return np.append(0, self.count)[np.where(ids >= RARE, 0, ids)]

    def classes(self, t: Tokens) -> np.ndarray:
        out = _tail_class(t.tail).astype(np.int64)
        if len(self.own_word):
            at = np.minimum(np.searchsorted(self.own_word, t.word), len(self.own_word) - 1)
            out = np.where(self.own_word[at] == t.word, at, out)
        return out

    def __getstate__(self):
        return {k: x for k, x in self.__dict__.items() if k != "_first"}

    def find(self, word: np.ndarray) -> np.ndarray:
        """1 + place of each word among the frequent ones, 0 for others. Hashes are spread evenly, so a table of their first bits
        leads to a few places."""
        out = np.zeros(len(word), np.int32)
        if not len(self.word):
            return out
        bits = len(self.word).bit_length() + 1
        if "_first" not in self.__dict__:
            self._first = np.append(np.searchsorted(self.word, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)), len(self.word)).astype(np.int32)
        bucket = (word >> np.uint64(64 - bits)).astype(np.int32)
        at, end = self._first[bucket], self._first[bucket + 1]
        left = np.flatnonzero(at < end)
        at, end, word = at[left], end[left], word[left]
        while len(left):
            same = self.word[at] == word
            out[left[same]] = at[same] + 1
            more = ~same & (at + 1 < end)
            left, at, end, word = left[more], at[more] + 1, end[more], word[more]
        return out

    def counts(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, is it a frequent word?)"""
        at = self.find(word)
        return np.append(0, self.count)[at], at > 0


def vocabulary(counts: DataFrame) -> Vocabulary:
    """From the table of counts: a histogram of counts gives the smallest count that at most ``TOP_WORDS`` words reach."""
    size = F.when(F.col("n") <= 1024, F.col("n")).otherwise((F.floor(8 * F.log2("n")) + 1024).cast("long"))
    bins = sorted((r["b"], r["k"], r["m"]) for r in counts.groupBy(size.alias("b")).agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("m")).collect())
    least, total = 2**62, 0
    for _, k, m in reversed(bins):
        total += k
        if total > TOP_WORDS:
            break
        least = m
    top = counts.where(F.col("n") >= least).toArrow()
    n_class, v_class = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for r in counts.groupBy("cls").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        n_class[r["cls"]], v_class[r["cls"]] = r["n"], r["v"]
    rest = counts.where(F.col("n") < least)
    buckets = 1 + min(BUCKETS - 1, rest.count() // (16 * (CLASSES - OWN)))
    rare = np.zeros((2, CLASSES, buckets), np.int64)
    bucket = F.shiftrightunsigned("word", 38) % buckets
    found = rest.groupBy("cls", bucket.cast("int").alias("bucket")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).toArrow()
    at = found.column("cls").to_numpy(), found.column("bucket").to_numpy()
    rare[0][at], rare[1][at] = found.column("n").to_numpy(), found.column("v").to_numpy()
    return Vocabulary(top.column("word").to_numpy().view(np.uint64), top.column("cls").to_numpy().astype(np.int64), top.column("n").to_numpy(), n_class, v_class, rare)


_READ = "doc_id long, row long, held_out boolean, n_tokens long, n_known long, total double, word long, n int, part int, data binary"


def _document_rows(docs: DataFrame, shared, rows_of_skips: int) -> DataFrame:
    """For each document its tokens, the frequent ones among them and the sum of their log10(count + 1) (word is null), and a row for
    each other word of a document with its count in it (doc_id, n_tokens are null). Beside them, from training documents: what a task counts
    for the skip feature (``part``: 0 up, a block of rows of ``skip_counts``), and how often what follows the words that are spread over
    groups (``part`` -1; word: place of the word before and outcome). The tokens of all documents are stored as ids (``part`` -2)."""

    def run(batches):
        v = shared.value
        kinds = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("total", pa.float64()), ("word", pa.int64()), ("n", pa.int32()), ("part", pa.int32()), ("data", pa.binary())])

        def batch(length, **columns):
            return pa.RecordBatch.from_arrays([columns[k.name] if k.name in columns else pa.nulls(length, k.type) for k in kinds], schema=kinds)

        logs, end = np.log10(np.append(0, v.count) + 1.0), v.end()
        skips = np.zeros((rows_of_skips, CLASSES + 2 * PARTS), np.float32)
        seen, held, keys, times, merged = [], 0, [], [], 0

        def follow():
            key, at = np.unique(np.concatenate(keys), return_inverse=True)
            return key, np.bincount(at, np.concatenate(times)).astype(np.int64)

        def follow_rows(key, n):
            for i in range(0, len(key), 100_000):
                k = slice(i, i + 100_000)
                yield batch(len(key[k]), word=pa.array(key[k]), n=pa.array(n[k].astype(np.int32)), part=pa.array(np.full(len(key[k]), -1, np.int32)))

        def flush():
            nonlocal seen, held, merged
            back2, outcome, back1 = (np.concatenate(x) for x in zip(*seen, strict=True))
            skips.__iadd__(skip_counts(back2, outcome, v, rows_of_skips))
            seen, held = [], 0
            many = np.flatnonzero(v.times(back1) > HOT_TOKENS)
            key, n = np.unique(back1[many].astype(np.int64) << 32 | outcome[many], return_counts=True)
            keys.append(key)
            times.append(n)
            merged += len(key)

        for b in batches:
            rows, learn = b.column(2).to_numpy(), ~b.column(3).to_numpy(zero_copy_only=False)
            for i, j, data, offsets in chunks(b.column(1)):
                t = Tokens(data, offsets)
                place, n = v.find(t.word), j - i
                sums = lambda x: np.add.reduceat(x, t.first[:-1])  # noqa: E731, B023
                yield batch(n, doc_id=b.column(0).slice(i, n), row=b.column(2).slice(i, n), held_out=b.column(3).slice(i, n), n_tokens=pa.array(np.diff(t.first)), n_known=pa.array(sums((place > 0).astype(np.int64))), total=pa.array(sums(logs[place])))
                rare = np.flatnonzero(place == 0)
                order = rare[np.lexsort((t.word[rare], t.doc[rare]))]
                at, n = _runs(t.doc[order], t.word[order])
                yield batch(len(at), row=pa.array(rows[i:j][t.doc[order[at]]]), word=pa.array(t.word[order[at]].view(np.int64)), n=pa.array(n.astype(np.int32)))
                ours = np.flatnonzero(learn[i:j][t.doc])
                ids = v.ids(t.word, v.classes(t), place)
                back1, back2 = before(ids, t.first, end)
                seen.append((back2[ours], v.outcomes(ids)[ours], back1[ours]))
                held += len(ours)
                stored = np.array([j - i], np.int32), rows[i:j], np.diff(t.first).astype(np.uint32), learn[i:j].astype(np.uint8), ids
                yield batch(1, part=pa.array([-2], pa.int32()), data=pa.array([b"".join(x.tobytes() for x in stored)], pa.binary()))
                if held > FLUSH_TOKENS // 4:
                    flush()
                    if merged > MERGE_ROWS:
                        key, n = follow()
                        keys, times, merged = [key], [n], len(key)
                        if merged > MERGE_ROWS // 2:  # memory stays bounded
                            yield from follow_rows(key, n)
                            keys, times, merged = [], [], 0
        if seen:
            flush()
        if keys:
            yield from follow_rows(*follow())
        size = max(1, rows_of_skips // BLOCKS)
        for k in range(0, rows_of_skips, size):
            if skips[k : k + size].any():
                yield batch(1, part=pa.array([k // size], pa.int32()), data=pa.array([skips[k : k + size].tobytes()], pa.binary()))

    return docs.select("doc_id", "text", "row", "held_out").mapInArrow(run, _READ)


def _sum_skips(found: DataFrame, v: Vocabulary, rows: int) -> Skips:
    """The skip feature's weights, from the sum of all tasks' counts."""

    def run(table):
        total = 0
        for x in table.column("data").to_pylist():
            total = total + np.frombuffer(x, np.float32).astype(np.float64)
        return pa.table({"part": table.column("part").slice(0, 1), "data": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    width = CLASSES + 2 * PARTS
    n = np.zeros((rows, width), np.float32)
    for r in found.where("part >= 0").select("part", "data").groupBy("part").applyInArrow(run, "part int, data binary").toLocalIterator():
        block = np.frombuffer(r["data"], np.float32).reshape(-1, width)
        n[r["part"] * len(block) : (r["part"] + 1) * len(block)] = block
    return Skips(n, v)


def base_scores(found: DataFrame, counts: DataFrame, v: Vocabulary) -> DataFrame:
    """doc_id, row, held_out, n_tokens, n_known, base_score, times, rare_total. found: see ``_document_rows``. Rows that repeat a document
    share its key: what is added up for the key is divided by how often it is there (times). rare_total: the sum of log10(count + 1) of rare words."""
    own = found.where("n_tokens IS NOT NULL").drop("word", "n", "part", "data")
    rare = found.where("word IS NOT NULL AND part IS NULL").select("row", "word", "n").join(counts.select("word", F.col("n").alias("c")), "word")
    rare = rare.groupBy("row").agg(F.sum("n").alias("rare_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("rare_total"))
    times = own.groupBy("row").agg(F.count(F.lit(1)).alias("times"))
    extra = times.join(rare, "row", "left").select("row", "times", (F.col("rare_known") / F.col("times")).cast("long").alias("rare_known"), (F.col("rare_total") / F.col("times")).alias("rare_total"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    base = F.col("total") + zero("rare_total") - F.col("n_tokens") * float(np.log10(v.tokens + v.distinct + 1))
    return own.join(extra, "row").select("doc_id", "row", "held_out", "n_tokens", "times", (F.col("n_known") + zero("rare_known")).alias("n_known"), base.alias("base_score"), zero("rare_total").alias("rare_total"))


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the runs of equal keys."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = False
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    at = np.flatnonzero(new)
    return at, np.diff(np.append(at, len(new)))


def step(n: np.ndarray, expected: np.ndarray, ridge: float) -> np.ndarray:
    """How far a weight moves: where the gradient n - expected * exp(x) - ridge * x is 0, by Newton steps from above."""
    n, expected = np.asarray(n, np.float64), np.maximum(expected, 1e-30)
    x = np.maximum(0, np.minimum(np.log(np.maximum(n, 1e-30) / expected), n / ridge))
    for _ in range(4):
        e = expected * np.exp(x)
        x -= (e + ridge * x - n) / (e + ridge)
    return x


def class_part(prior: np.ndarray, back1: np.ndarray, back2: np.ndarray, cls: np.ndarray, times: np.ndarray, rounds: int = ROUNDS, skip: np.ndarray | None = None, known: tuple | None = None) -> np.ndarray:
    """Natural log of the probability of each event's class; events are sorted by (back1, back2). Logits depend on the pair of words
    before only, so all sums go over pairs: a row of ``CLASSES`` counts and gradients for each. ``skip``: weights of the skip feature
    of each pair; ``known``: (which words before, their counts by class), where these events are not all that follow a word."""
    at, length = _runs(back1, back2)
    pair = np.repeat(np.arange(len(at)), length)
    n = np.bincount(pair * CLASSES + cls, times, minlength=len(at) * CLASSES).astype(np.float32).reshape(-1, CLASSES)
    total = n.sum(1, keepdims=True)
    start, size = _runs(back1[at])
    x = np.tile(prior.astype(np.float32), (len(at), 1))

    def move(g: np.ndarray, c: np.ndarray, ridge: float) -> np.ndarray:
        return np.clip(g / (c + np.float32(ridge)), -LARGEST, LARGEST)

    for k in range(rounds):
        if k:
            g, c = np.empty_like(n), np.empty_like(n)
            _residuals(x, n, total, g, c)
            g, c = (np.add.reduceat(y, start, axis=0) for y in (g, c))
        else:  # the first round starts at the prior: only counts matter, which may come from other tasks, too
            first = np.add.reduceat(n, start, axis=0)
            if known is not None:
                first[known[0]] = known[1]
            p = np.exp(x[:1] - x[:1].max())
            p /= p.sum()
            g, c = first - first.sum(1, keepdims=True) * p, first.sum(1, keepdims=True) * (p * (1 - p))
        x += np.repeat(move(g, c, RIDGE[0]), size, axis=0)
        if not k and skip is not None:
            x += skip[at]
        for i in range(0, len(x), ROWS):  # the two words before: each pair's row is its own
            j = slice(i, i + ROWS)
            g, c = np.empty_like(n[j]), np.empty_like(n[j])
            _residuals(x[j], n[j], total[j], g, c)
            x[j] += move(g, c, RIDGE[1])
    top = x.max(1)
    return (x[pair, cls] - (np.log(np.exp(x - top[:, None]).sum(1)) + top)[pair]).astype(float)


def _residuals(x: np.ndarray, n: np.ndarray, total: np.ndarray, gradient: np.ndarray, curvature: np.ndarray) -> None:
    p = np.exp(x - x.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    q = total * p
    np.subtract(n, q, out=gradient)
    np.multiply(q, 1 - p, out=curvature)


class Skips:
    """Weights of the skip feature, shared by all tasks: hashed rows by the word before the last for classes, and by it and the class for
    ``PARTS`` parts of a class's outcomes. From counts over all training tokens: ``n``: rows x (CLASSES + PARTS)."""

    def __init__(self, n: np.ndarray, v: Vocabulary):
        self.rows = len(n)
        by_class, by_part = n[:, :CLASSES].astype(np.float64), n[:, CLASSES:].astype(np.float64)
        p = np.exp(v.prior - v.prior.max())
        p /= p.sum()
        total = by_class.sum(1, keepdims=True)
        self.cls = (SHARE * np.clip((by_class - total * p) / (total * p * (1 - p) + RIDGE[2]), -LARGEST, LARGEST)).astype(np.float32)
        # Rows of parts are hashed by class too, so what is expected is counted beside: see ``skip_counts``.
        seen, wanted = by_part[:, :PARTS], by_part[:, PARTS:]
        self.part = (SHARE * np.clip((seen - wanted) / (wanted + RIDGE[2]), -LARGEST, LARGEST)).astype(np.float32)


def skip_cells(back2: np.ndarray, cls: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Row for classes, row for parts. back2: 32 bits."""
    back2 = back2.astype(np.uint64)
    return (mix(back2 + np.uint64(12)) % np.uint64(rows)).astype(np.int64), (mix(back2 * np.uint64(CLASSES) + cls.astype(np.uint64) + (np.uint64(1) << np.uint64(40))) % np.uint64(rows)).astype(np.int64)


def skip_counts(back2: np.ndarray, outcome: np.ndarray, v: Vocabulary, rows: int) -> np.ndarray:
    """rows x (CLASSES + 2 * PARTS): counts by class; counts and expected counts (at the prior) by part of a class."""
    cls = v.cls_of[outcome].astype(np.int64)
    one, two = skip_cells(back2, cls, rows)
    out = np.empty((rows, CLASSES + 2 * PARTS), np.float32)
    out[:, :CLASSES] = np.bincount(one * CLASSES + cls, minlength=rows * CLASSES).reshape(rows, CLASSES)
    out[:, CLASSES : CLASSES + PARTS] = np.bincount(two * PARTS + v.part[outcome], minlength=rows * PARTS).reshape(rows, PARTS)
    at, times = np.unique(two * CLASSES + cls, return_counts=True)
    for g in range(PARTS):
        out[:, CLASSES + PARTS + g] = np.bincount(at // CLASSES, times * v.shares[at % CLASSES, g], rows)
    return out


def event_scores(back1: np.ndarray, back2: np.ndarray, outcome: np.ndarray, times: np.ndarray, v: Vocabulary, skips: Skips | None = None, hot: dict | None = None, rounds: int = ROUNDS) -> np.ndarray:
    """Natural log of the probability of each outcome; distinct events, sorted by (back1, back2, outcome). Trains the weights of the
    first two features from these events, which are all of their words before, but for the words in ``hot``: their counts over the whole
    corpus are given (outcomes, counts). The softmax within a class runs over all its outcomes: what outcomes without a weight add is known by
    class and part, the others are added one by one."""
    cls = v.cls_of[outcome].astype(np.int64)
    first, size = _runs(back1)
    head = np.repeat(np.arange(len(first)), size)
    wide = np.int64(len(v.share))
    keys, ns = head * wide + outcome, times
    known = None
    if hot:
        which = [(i, hot[int(w)]) for i, w in enumerate(back1[first]) if int(w) in hot]
        if which:
            ns = np.where(np.isin(head, [i for i, _ in which]), 0.0, times)
            known = np.array([i for i, _ in which]), np.stack([np.bincount(v.cls_of[o], n, minlength=CLASSES) for _, (o, n) in which])
            keys = np.concatenate([keys, *(i * wide + o for i, (o, _) in which)])
            ns = np.concatenate([ns, *(n for _, (_, n) in which)])
    skip = None
    if skips is not None:
        one, two = skip_cells(back2, cls, skips.rows)
        skip = skips.cls[one]
    out = class_part(v.prior, back1, back2, cls, times, rounds, skip, known)

    # The word before.
    pairs, inverse = np.unique(keys, return_inverse=True)
    n = np.bincount(inverse, ns)
    o = pairs % wide
    share, of = v.share[o], v.cls_of[o].astype(np.int64)
    at, length = _runs(pairs // wide, of)
    row = np.repeat(np.arange(len(at)), length)
    weight = np.where(n > 0, step(n, np.add.reduceat(n, at)[row] * share, WORD_RIDGE[0]), 0.0)
    mass = v.shares[of[at]] + np.bincount(row * PARTS + v.part[o], share * np.expm1(weight), len(at) * PARTS).reshape(-1, PARTS)
    mine = inverse[: len(outcome)]
    weight, mass_of, share, part = weight[mine], row[mine], share[mine], v.part[outcome]

    # The skip, then the two words before.
    at, length = _runs(back1, back2, cls)
    row = np.repeat(np.arange(len(at)), length)
    if skips is not None:
        rates = np.exp(skips.part[two[at]].astype(np.float64))
        whole = (mass[mass_of[at]] * rates).sum(1)
        like = share * np.exp(weight) * rates[row, part]
    else:
        whole, like = mass[mass_of[at]].sum(1), share * np.exp(weight)
    n = np.add.reduceat(times, at)
    weight = np.where(times > 0, step(times, n[row] * like / whole[row], WORD_RIDGE[1]), 0.0)
    whole += np.add.reduceat(like * np.expm1(weight), at)
    return out + np.log(like) + weight - np.log(whole)[row] - np.log(v.inside[outcome])


def shard_scores(back1: np.ndarray, back2: np.ndarray, word: np.ndarray, cls: np.ndarray, learn: np.ndarray, v: Vocabulary, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """A model of these tokens alone, without the skip feature. (log10 probability of each token, does log10(count + 1) of a rare word have to be added?)"""
    place = v.find(word)
    scores = token_scores(back1, back2, v.outcomes(v.ids(word, cls, place)), learn, v, rounds=rounds)
    return scores, place == 0


def token_scores(back1: np.ndarray, back2: np.ndarray, outcome: np.ndarray, learn: np.ndarray, v: Vocabulary, skips: Skips | None = None, hot: dict | None = None, rounds: int = ROUNDS) -> np.ndarray:
    """log10 probability of each token, but for log10(count + 1) of rare words. Events go through some ten thousand at once, cut between
    words before."""
    heads, index = np.unique(back1, return_inverse=True)
    bits, wide = len(heads).bit_length(), int(len(v.share)).bit_length()
    left = np.uint64(min(32, 64 - bits - wide))
    key = ((index.astype(np.uint64) << left) | (mix(back2.astype(np.uint64)) >> (np.uint64(64) - left))) << np.uint64(wide) | outcome.astype(np.uint64)
    order = np.argsort(key)
    at, length = _runs(key[order])
    times = np.add.reduceat(learn[order].astype(float), at) if len(at) else np.zeros(0)
    e = order[at]
    one, two, what = back1[e], back2[e], outcome[e]
    ends, begin, got = np.append(_runs(one)[0][1:], len(e)), 0, []
    while begin < len(e):
        end = int(ends[min(np.searchsorted(ends, begin + EVENTS), len(ends) - 1)])
        k = slice(begin, end)
        got.append(event_scores(one[k], two[k], what[k], times[k], v, skips, hot, rounds))
        begin = end
    out = np.empty(len(order))
    out[order] = np.repeat(np.concatenate(got), length) / np.log(10) if got else 0.0
    return out


def pair_place(pairs: np.ndarray, back1: np.ndarray, back2: np.ndarray) -> np.ndarray:
    """Where each pair of ids before is in ``pairs`` (sorted, at least one), -1 where it isn't."""
    key = back1.astype(np.uint64) << np.uint64(32) | back2.astype(np.uint64)
    at = np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)
    return np.where(pairs[at] == key, at, -1)


def group_of(back1: np.ndarray, count: np.ndarray, back2: np.ndarray, groups: int, pairs: np.ndarray, pair_n: np.ndarray, row: np.ndarray) -> np.ndarray:
    """All that follows a word is in one group, so its weights are; where too many tokens follow it (``count``), all that follows a pair; and
    where too many follow that (``pairs``, ``pair_n``), it is spread by document."""
    x = mix(back1)
    many = np.flatnonzero(count > HOT_TOKENS)
    if len(many):
        pieces = (1 + count[many] // HOT_TOKENS).astype(np.uint64)
        x[many] += mix(back2[many].astype(np.uint64) + np.uint64(7)) % pieces
        if len(pairs):
            at = pair_place(pairs, back1[many], back2[many])
            many, at = many[at >= 0], at[at >= 0]
            x[many] = mix(pairs[at]) + mix(row[many].view(np.uint64)) % (1 + pair_n[at] // HOT_TOKENS).astype(np.uint64)
    return (x % np.uint64(groups)).astype(np.int32)


def pack(back1: np.ndarray, back2: np.ndarray, place: np.ndarray, word: np.ndarray, row: np.ndarray, kind: np.ndarray) -> bytes:
    """Tokens sorted by ``back1``, about half as large as their columns: frequent words by their place, the word before and the
    documents by short indices."""
    at, length = _runs(back1)
    rows, index = np.unique(row, return_inverse=True)
    rare = word[place == 0]
    index = index.astype(np.uint16 if len(rows) < 1 << 16 else np.uint32)
    columns = (np.array([len(word), len(at), len(rows), len(rare), index.itemsize], np.int32), back1[at], rows, rare, length.astype(np.uint32), back2, place, index, kind)
    return b"".join(np.ascontiguousarray(x).tobytes() for x in columns)


def unpack(data: bytes, v: Vocabulary) -> tuple[np.ndarray, ...]:
    """back1, back2, word, row, kind."""
    back1, back2, place, rare, row, kind = _fields(data)
    word = np.append(np.uint64(0), v.word)[place]
    word[place == 0] = rare
    return back1, back2.astype(np.uint64), word, row, kind


def _fields(data: bytes) -> tuple[np.ndarray, ...]:
    """back1, back2, place, rare words, row, kind."""
    n, heads, docs, rare, width = np.frombuffer(data, np.int32, 5)
    at = 20
    out = []
    for dtype, k in ((np.uint64, heads), (np.int64, docs), (np.uint64, rare), (np.uint32, heads), (np.uint32, n), (np.int32, n), (np.uint16 if width == 2 else np.uint32, n), (np.uint8, n)):
        out.append(np.frombuffer(data, dtype, k, at))
        at += int(k) * np.dtype(dtype).itemsize
    back1, rows, rare, length, back2, place, index, kind = out
    return np.repeat(back1, length), back2, place, rare, rows[index], kind


def _stored(data: pa.BinaryScalar) -> list[np.ndarray]:
    """Documents' keys, numbers of tokens, are they learned from?; tokens' ids."""
    data = data.as_buffer()
    n = int(np.frombuffer(data, np.int32, 1)[0])
    return [np.frombuffer(data, dtype, k, at) for dtype, k, at in ((np.int64, n, 4), (np.uint32, n, 4 + 8 * n), (np.uint8, n, 4 + 12 * n), (np.uint32, -1, 4 + 13 * n))]


def _deal(found: DataFrame, shared, pairs: tuple, groups: int, of: int, which: int) -> DataFrame:
    """grp, hot, data: packed tokens of the groups whose number is ``which`` modulo ``of`` (hot is null); outcomes go in the place of words'
    places. Words before are ids. found: see ``_document_rows``."""

    def run(batches):
        v = shared.value
        parts, held, end = [], 0, v.end()

        def out():
            group, back1, *others = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((back1, group))
            group, *columns = (x[order] for x in (group, back1, *others))
            at, length = _runs(group)
            for i in range(0, len(at), 64):
                data = [pack(*(x[lo : lo + n] for x in columns)) for lo, n in zip(at[i : i + 64], length[i : i + 64], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(group[at[i : i + 64]]), pa.nulls(len(data), pa.int64()), pa.array(data, pa.binary())], names=["grp", "hot", "data"])

        for b in batches:
            for data in b.column(0):
                rows, size, learn, ids = _stored(data)
                n = len(rows)
                back1, back2 = before(ids, np.append(0, np.cumsum(size, dtype=np.int64)), end)
                doc = np.repeat(np.arange(n), size)
                group = group_of(back1.astype(np.uint64), v.times(back1), back2, groups, *pairs, rows[doc])
                ours = np.flatnonzero(group % of == which)
                if not len(ours):
                    continue
                doc, outcome = doc[ours], 1 + v.outcomes(ids[ours])
                parts.append((group[ours], back1[ours].astype(np.uint64), back2[ours], outcome, outcome, rows[doc], learn[doc] << np.uint8(7)))
                held += len(ours)
                if held > FLUSH_TOKENS:
                    yield from out()
                    parts, held = [], 0
        if parts:
            yield from out()

    return found.where("part = -2").select("data").mapInArrow(run, "grp int, hot long, data binary")


def _follow(found: DataFrame) -> DataFrame:
    """place, outcome, n: what follows the words that are spread over groups."""
    follow = found.where("part = -1").groupBy("word").agg(F.sum("n").alias("n"))
    return follow.select(F.shiftright("word", 32).alias("place"), F.col("word").bitwiseAND(F.lit(0xFFFFFFFF)).alias("outcome"), "n")


def hot_pairs(found: DataFrame, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of words (the one before, the one before that, as one number) that more than ``HOT_TOKENS`` training tokens follow, and how many."""
    if not (v.count > HOT_TOKENS).any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    place = np.zeros(len(v.share), np.int64)
    place[v.by_place[1:]] = np.arange(1, len(v.by_place))
    got = {int(place[r["outcome"]]) << 32 | r["place"]: r["n"] for r in _follow(found).where(F.col("n") > HOT_TOKENS).collect() if place[r["outcome"]]}
    end = v.end()
    n = int(v.times(np.array([end], np.uint32))[0])
    if n > HOT_TOKENS:  # texts' first words
        got[end << 32 | end] = n
    keys = np.array(sorted(got), np.uint64)
    return keys, np.array([got[int(k)] for k in keys], np.int64)


def _pair_counts(found: DataFrame, shared, pairs: np.ndarray) -> DataFrame:
    """hot, outcome, n: what follows each of the pairs in all training documents."""

    def run(batches):
        v = shared.value
        end, keys, times, held = v.end(), [], [], 0

        def merged():
            key, at = np.unique(np.concatenate(keys), return_inverse=True)
            return key, np.bincount(at, np.concatenate(times)).astype(np.int64)

        for b in batches:
            for data in b.column(0):
                _, size, learn, ids = _stored(data)
                back1, back2 = before(ids, np.append(0, np.cumsum(size, dtype=np.int64)), end)
                at = pair_place(pairs, back1, back2)
                ours = np.flatnonzero((at >= 0) & (np.repeat(learn, size) > 0))
                key, n = np.unique(at[ours] << 32 | v.outcomes(ids[ours]), return_counts=True)
                keys.append(key)
                times.append(n)
                held += len(key)
                if held > MERGE_ROWS:
                    key, n = merged()
                    keys, times, held = [key], [n], len(key)
        if keys:
            key, n = merged()
            for i in range(0, len(key), 100_000):
                k = slice(i, i + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[key[k] >> 32].view(np.int64)), pa.array(key[k] & 0xFFFFFFFF), pa.array(n[k])], names=["place", "outcome", "n"])

    return found.where("part = -2").select("data").mapInArrow(run, "place long, outcome long, n long").groupBy("place", "outcome").agg(F.sum("n").alias("n"))


def hot_rows(found: DataFrame, shared, v: Vocabulary, pairs: tuple, groups: int) -> DataFrame | None:
    """grp, hot, data: for each word, and each pair of words, whose tokens are spread over groups (hot: its place, or the pair as one number), what
    follows it in all training documents and how often (outcomes, counts), for each of its groups."""
    many = np.flatnonzero(v.count > HOT_TOKENS)
    if not len(many):
        return None
    where = set()

    def pieces(key: int, n: int) -> list[int]:
        return ((mix(np.array([key], np.uint64)) + np.arange(1 + n // HOT_TOKENS, dtype=np.uint64)) % np.uint64(groups)).tolist()

    for k in many:
        where |= {(int(k) + 1, g) for g in pieces(int(k) + 1, int(v.count[k]))}
    for key, n in zip(*(x.tolist() for x in pairs), strict=True):
        at = pieces(key, n)
        where |= {(key, g) for g in at} | {(key >> 32, g) for g in at}

    def run(table):
        outcome, n = table.column("outcome").to_numpy().astype(np.int32), table.column("n").to_numpy().astype(np.int64)
        return pa.table({"hot": table.column("place").slice(0, 1), "data": pa.array([outcome.tobytes() + n.tobytes()], pa.binary())})

    follow = _follow(found)
    if len(pairs[0]):
        follow = follow.unionByName(_pair_counts(found, shared, pairs[0]))
    lists = follow.groupBy("place").applyInArrow(run, "hot long, data binary")
    return materialise(lists.join(found.sparkSession.createDataFrame(sorted(where), "hot long, grp int"), "hot").select("grp", "hot", "data"), "hot-words")


def _group_scores(dealt: DataFrame, shared, skips, buckets: int) -> DataFrame:
    """bucket, data: for each bucket of documents, what a batch of groups adds to them, packed: documents and sums of log10 probabilities. Groups go
    one by one; a document's sums over a batch are one, so what is sent back grows less with the number of groups."""

    def group(words, packed):
        tokens, hot = [], {}
        for word, x in zip(words.to_pylist(), packed.to_pylist(), strict=True):
            if word is None:
                tokens.append(_fields(x))
            else:
                n = len(x) // 12
                hot[word] = np.frombuffer(x, np.int32, n), np.frombuffer(x, np.int64, n, 4 * n)
        if not tokens:
            return np.zeros(0, np.int64), np.zeros(0)
        back1, back2, outcome, _, row, kind = (np.concatenate(x) for x in zip(*tokens, strict=True))
        del tokens
        rows, at = np.unique(row, return_inverse=True)
        learn, outcome, pairs = (kind > 127).astype(float), outcome - 1, {k: x for k, x in hot.items() if k >> 32}
        if pairs:  # learned from their counts over the whole corpus, not from the tokens here
            keys = np.array(sorted(pairs), np.uint64)
            learn[pair_place(keys, back1, back2) >= 0] = 0
            for k in keys.tolist():
                what, n = pairs[k]
                back1, back2 = np.append(back1, np.full(len(n), k >> 32, np.uint64)), np.append(back2, np.full(len(n), k & 0xFFFFFFFF, np.uint32))
                outcome, learn = np.append(outcome, what), np.append(learn, n)
        return rows, np.bincount(at, token_scores(back1, back2, outcome, learn, shared.value, skips.value, hot)[: len(at)])

    def run(table):
        number = table.column("grp").to_numpy()
        parts = [group(*(table.column(k).take(pa.array(np.flatnonzero(number == g))) for k in ("hot", "data"))) for g in np.unique(number)]
        row, score = (np.concatenate(x) for x in zip(*parts, strict=True))
        rows, at = np.unique(row, return_inverse=True)
        bucket = (rows.view(np.uint64) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        bucket, rows, sums = (x[order] for x in (bucket, rows, np.bincount(at, score).astype(np.float32)))
        start, size = _runs(bucket)
        data = [np.array([n], np.int32).tobytes() + rows[i : i + n].tobytes() + sums[i : i + n].tobytes() for i, n in zip(start, size, strict=True)]
        return pa.table({"bucket": bucket[start], "data": pa.array(data, pa.binary())})

    return dealt.groupBy("batch").applyInArrow(run, "bucket int, data binary")


def _bucket_sums(packed: DataFrame) -> DataFrame:
    """row, total: sums of each document."""

    def run(table):
        parts = []
        for x in table.column("data").to_pylist():
            n = int(np.frombuffer(x, np.int32, 1)[0])
            parts.append((np.frombuffer(x, np.int64, n, 4), np.frombuffer(x, np.float32, n, 4 + 8 * n)))
        row, total = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((total, row))  # sums don't depend on the order in which groups come
        rows, at = np.unique(row[order], return_inverse=True)
        return pa.table({"row": rows, "total": np.bincount(at, total[order])})

    return packed.groupBy("bucket").applyInArrow(run, "row long, total double")


def _let_go(spark) -> None:
    """Spark deletes a shuffle's files when nothing refers to it any more, in Python or the driver's JVM, and garbage has been collected."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def word_scores(found: DataFrame, shared, v: Vocabulary, rows: int) -> DataFrame:
    """row, sum: sum of the log10 probabilities of a document's tokens, but for log10(count + 1) of rare words."""
    spark = found.sparkSession
    skips = spark.sparkContext.broadcast(_sum_skips(found, v, rows))
    groups = 1 + v.tokens * 7 // (6 * GROUP_SHARDS * SHARD_TOKENS)
    pairs = hot_pairs(found, v)
    hot = hot_rows(found, shared, v, pairs, groups)
    slices, each = (SLICES, TASK_GROUPS) if groups > 8 * SLICES else (1, 1)
    sums = []
    for k in range(slices):
        dealt = _deal(found, shared, pairs, groups, slices, k)
        if hot is not None:
            dealt = dealt.unionByName(hot.where(F.col("grp") % slices == k))
        dealt = dealt.withColumn("batch", F.floor(F.col("grp") / (slices * each)).cast("int"))
        tasks = groups // (slices * each)
        if tasks > partitions(spark):  # as many as there are tokens for
            dealt = dealt.repartition(tasks, "batch")
        got = _bucket_sums(_group_scores(dealt, shared, skips, groups))
        sums.append(materialise(got, "group-sums"))
        del got, dealt
        if slices > 1:
            _let_go(spark)
    every = sums[0]
    for x in sums[1:]:
        every = every.unionByName(x)
    return every.groupBy("row").agg(F.sum("total").alias("sum"))


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row."""
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    counts = materialise(word_counts(docs), "word-counts")
    v = vocabulary(counts)
    shared = spark.sparkContext.broadcast(v)
    rows = min(SKIP_ROWS, max(1024, 1 << (v.tokens // 64).bit_length()))
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"), (~training(F.col("doc_id"))).alias("held_out"))
    found = materialise(_document_rows(keyed, shared, rows), "document-rows", "zstd")
    sums = word_scores(found, shared, v, rows)
    base = base_scores(found, counts, v)
    return base.join(sums, "row", "left").select("doc_id", "held_out", "n_tokens", "n_known", F.lit(v.tokens).cast("long").alias("train_tokens"), "base_score", (F.col("sum") / F.col("times") + F.col("rare_total")).alias("score"))
