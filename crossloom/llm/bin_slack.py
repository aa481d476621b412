"""Best-fit packing by minimum bin slack: each sequence takes the fullest combination of the lengths that are left.

Documents are encoded and cut where they are read; what goes on is a narrow row for each piece. Only how many pieces there are of each
length matters for packing, and that is a table of at most ``capacity`` rows however large the corpus is. On that table, a dynamic
program over sums finds the fullest combination of available lengths: a bit for each sum that can be reached, a shift for each
length (in powers of two of its count), traced back so that long pieces are preferred. A combination is taken out as often as the
counts allow, which equals taking it out again and again. Each such step leaves some length with fewer pieces than the combination
has of it, so there are at most about capacity * (1 + ln capacity) steps, whatever the corpus.

Pieces then find their places: a piece's number among those of its length is its number within the task that cut it, plus those of
the tasks before. No length, however frequent, is gathered or sorted in one task.

A null or empty text is one piece with the id 0 alone. Rows that repeat a doc_id, or have none, are packed like others. Extra columns don't matter,
as only ids and texts are read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crossloom.runtime import materialise, prepare

CAPACITY = 2048
#: Words whose ids a worker keeps; longer words than LONG_WORD aren't kept.
MEMO_WORDS, LONG_WORD = 800_000, 64


#: Words of which it is known without the library where the tokenizer's pattern cuts them: visible ASCII and the letters of Latin-1. PARTS is
#: that pattern for them, once in lower case (their only normalisation).
KNOWN = re.compile(r"[!-~\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\xff]+")


class WordIds:
    """Ids of texts, as little-endian unsigned 32-bit numbers. The tokenizer drops white space and never joins across it, so a text's ids are
    those of its words (split at ASCII white space) one after the other, and a word's ids those of its parts: new parts are encoded once, as
    one text, whose ids are cut where a part's last id is (``</w>``). The memo has two generations: words in use stay, memory is bounded."""

    def __init__(self, tokenizer_file: str, end: int = 0):
        # A task has one core: threads of the library's own would only wait for each other.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.end = np.array([end], "<u4").tobytes()
        self.memo: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True
        self.added = re.compile("|".join(re.escape(x.content) for x in self.tokenizer.get_added_tokens_decoder().values()) or "(?!)")

    def _encoded(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn_parts(self, parts: list[str]) -> dict[bytes, bytes]:
        out = {}
        for at in range(0, len(parts), 10_000):
            own = parts[at : at + 10_000]
            ids = self._encoded(" ".join(own))
            cut = [0, *(4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()]
            raw = ids.tobytes()
            out.update((p.encode(), raw[a:b]) for p, a, b in zip(own, cut[:-1], cut[1:], strict=True))
        return out

    def learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """The ids of words that the memo lacks, and of parts met on the way."""
        memo, older, out, cut, new = self.memo, self.older, {}, {}, set()
        for w in words:
            if w in older:
                out[w] = older[w]
                continue
            x = w.decode()
            if not KNOWN.fullmatch(x) or self.added.search(x):
                out[w] = self._encoded(x).tobytes()
                continue
            cut[w] = parts = PARTS.findall(x.lower())
            for p in parts:
                k = p.encode()
                if k not in memo:
                    if k in older:
                        out[k] = older[k]
                    else:
                        new.add(p)
        out |= self._learn_parts(list(new))
        for w, parts in cut.items():
            out[w] = b"".join([memo[k] if k in memo else out[k] for k in map(str.encode, parts)])
        return out

    def __call__(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Each text's ids and ``end``."""
        for text in texts:
            words, memo = (text or "").encode().split(), self.memo
            missing = set(words).difference(memo)
            got = self.learn(missing) if missing else {}
            memo.update(got)
            yield b"".join([*map(memo.__getitem__, words), self.end])
            for w in got:
                if len(w) > LONG_WORD:
                    del memo[w]
            if len(memo) >= MEMO_WORDS:
                self.older, self.memo = memo, {}


_IDS: dict[tuple[str, int], WordIds] = {}


def word_ids(tokenizer_file: str, end: int = 0) -> WordIds:
    """One a worker, file and end."""
    if (tokenizer_file, end) not in _IDS:
        _IDS[tokenizer_file, end] = WordIds(tokenizer_file, end)
    return _IDS[tokenizer_file, end]


_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, _task int, _number long"


def pieces(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """A row for each piece of at most ``capacity`` ids (each text's ids, then 0): doc_id, piece, start, length, ids_crc32, the task that
    cut it, and its number (from 0) among the task's pieces of that length; ``keep_ids`` adds the ids themselves."""
    prepare(docs.sparkSession)
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), *([pa.list_(pa.int32())] if keep_ids else [])]
    schema = _PIECE + (", ids array<int>" if keep_ids else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        from pyspark import TaskContext

        task, seen, encode = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), word_ids(tokenizer_file)
        for b in batches:
            rows = []
            for i, ids in zip(b.column(0).to_pylist(), encode(x.as_py() for x in b.column(1)), strict=True):
                view, n = memoryview(ids), len(ids) // 4
                for piece, start in enumerate(range(0, n, capacity)):
                    length = min(capacity, n - start)
                    own = view[4 * start : 4 * (start + length)]
                    rows.append((i, piece, start, length, zlib.crc32(own), task, int(seen[length]), *([np.frombuffer(own, "<i4")] if keep_ids else [])))
                    seen[length] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def fullest(counts: dict[int, int], capacity: int, first: int | None = None) -> dict[int, int]:
    """length: times of the combination of available lengths with the greatest sum of at most ``capacity``; of equal sums, one with
    long pieces. ``first``: a length that must be in it."""
    left = dict(counts)
    room = capacity
    if first is not None:
        left[first] -= 1
        room -= first
    mask, reach = (1 << room + 1) - 1, [1]
    steps: list[tuple[int, int]] = []
    for length in sorted(left):
        n, size = min(left[length], room // length), 1
        while n > 0:
            size = min(size, n)
            steps.append((length, size))
            reach.append((reach[-1] | reach[-1] << length * size) & mask)
            n, size = n - size, size * 2
    total = reach[-1].bit_length() - 1
    out = {} if first is None else {first: 1}
    # Back from the longest: a step is used where its sum can be reached with it.
    for (length, size), before in zip(reversed(steps), reversed(reach[:-1]), strict=True):
        part = length * size
        if part <= total and before >> total - part & 1:
            out[length] = out.get(length, 0) + size
            total -= part
    return out


def combinations(counts: dict[int, int], capacity: int = CAPACITY, anchored: bool = False) -> list[tuple[int, dict[int, int]]]:
    """(times, combination): every piece is in one. ``anchored``: each combination has to hold the longest piece that is left."""
    left = {k: n for k, n in counts.items() if n > 0}
    out = []
    while left:
        took = fullest(left, capacity, max(left) if anchored else None)
        times = min(left[k] // n for k, n in took.items())
        out.append((times, took))
        for k, n in took.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return out


def best_combinations(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """The fullest combinations as they come; where they need more sequences than the sum of lengths asks for, also those that hold the longest
    piece left, if these need fewer."""
    plain = combinations(counts, capacity)
    used = lambda x: sum(t for t, _ in x)
    if used(plain) <= -(-sum(k * n for k, n in counts.items()) // capacity):
        return plain
    return min(plain, combinations(counts, capacity, anchored=True), key=used)


def places(plan: list[tuple[int, dict[int, int]]]) -> dict[str, np.ndarray]:
    """The plan as rows by length, then first number: the length's pieces from that number on go, ``times`` a sequence, to the sequences from
    ``sequence`` on, from ``offset`` on."""
    rows, taken, sequence = [], {}, 0
    for repeats, took in plan:
        offset = 0
        for length in sorted(took, reverse=True):
            rows.append((length, taken.get(length, 0), took[length], sequence, offset))
            taken[length] = taken.get(length, 0) + took[length] * repeats
            offset += length * took[length]
        sequence += repeats
    rows.sort()
    return dict(zip(("length", "first", "times", "sequence", "offset"), np.array(rows, np.int64).reshape(-1, 5).T.copy(), strict=True))


def pack(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of ``docs`` (doc_id, text); ``keep_ids`` adds ids, from
    which sequences are put together by ``sequences``."""
    spark = docs.sparkSession
    cut = materialise(pieces(docs, tokenizer_file, capacity, keep_ids), "pieces")
    per_task = materialise(cut.groupBy("_task", "length").agg(F.count(F.lit(1)).alias("_n")), "piece-counts")
    counts = {r["length"]: r["_n"] for r in per_task.groupBy("length").agg(F.sum("_n").alias("_n")).collect()}
    plan = spark.sparkContext.broadcast(places(best_combinations(counts, capacity)))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    earlier = per_task.select("_task", "length", F.coalesce(before, F.lit(0)).alias("_before"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        p, length, number = plan.value, length.to_numpy(np.int64), number.to_numpy(np.int64)
        out = np.zeros((2, len(length)), np.int64)
        kinds, row = np.unique(length, return_inverse=True)
        for k, own in enumerate(kinds):
            lo, hi = np.searchsorted(p["length"], [own, own + 1])
            at = np.flatnonzero(row == k)
            r = lo + np.searchsorted(p["first"][lo:hi], number[at], "right") - 1
            in_bin, slot = np.divmod(number[at] - p["first"][r], p["times"][r])
            out[:, at] = p["sequence"][r] + in_bin, p["offset"][r] + slot * own
        return pd.DataFrame({"sequence_id": out[0], "offset": out[1]})

    placed = cut.join(earlier, ["_task", "length"]).withColumn("_place", place("length", F.col("_number") + F.col("_before")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "_place.sequence_id", "_place.offset", *(["ids"] if keep_ids else []))


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids, and the doc_ids and lengths of its pieces in order, of a table with ids. A sequence has at most ``capacity`` ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("_p")).select(
        "sequence_id", F.flatten(F.col("_p.ids")).alias("ids"), F.col("_p.doc_id").alias("doc_ids"), F.col("_p.length").alias("lengths")
    )
