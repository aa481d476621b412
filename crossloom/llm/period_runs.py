"""Periodic runs of words: a suffix automaton whose ordered sets of end positions are merged, small into large.

A run is a stretch of consecutive words with smallest period q, of at least ``max(SHORTEST, TIMES * q)`` words, that no neighbouring
word extends keeping that period. Each state of the automaton of a text's words stands for the sub-texts that end at the same
positions; its set of end positions is the union of its children's. Sets are ordered, and the smaller one is put into the larger one
element by element. An element that gets a neighbour at a distance d of no more than the state's length is the end of a square of
period d, since the words before both ends agree over d places at least; such a seed is extended to both sides. The last whole
period of a run ends where its words ended one period before, and no closer end lies between (a shorter period would follow), so
every run is seeded by its smallest period; a stretch that is seeded by multiples of it too keeps the smallest.

The automaton reads only words that may lie in a run: every eight consecutive words of a run occur again in it, so a text is cut
where eight words don't occur again within the same piece, until nothing changes. That leaves out no run, whatever the text.

Texts are judged on their own, in the tasks that read them: nothing is shuffled, and memory follows the longest text.

Null or empty texts have no words and no runs; rows that repeat a doc_id are judged by their own texts; equal exponents go to the
smallest start, then period; extra columns of any name don't matter, as only ids and texts are read.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossloom.llm._batches import mix
from crossloom.llm._columns import kept, unused
from crossloom.runtime import prepare

#: Words and periods that a run has at least.
SHORTEST, TIMES = 24, 3
#: Every so many consecutive words of a run occur again in it (SHORTEST // TIMES is the most for which that holds).
GRAM = SHORTEST // TIMES


class Automaton:
    """The suffix automaton of a sequence: transitions, suffix links and lengths of states; ``end[k]``: the last position of state k's
    own prefix, -1 for clones."""

    def __init__(self, seq: Sequence[int]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.end = [-1], [0], [-1]
        nxt, link, length, end = self.next, self.link, self.length, self.end
        last = 0
        for i, c in enumerate(seq):
            cur = len(length)
            length.append(i + 1)
            end.append(i)
            nxt.append({})
            link.append(0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    clone = len(length)
                    length.append(length[p] + 1)
                    end.append(-1)
                    nxt.append(nxt[q].copy())
                    link.append(link[q])
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur


def squares(seq: Sequence[int]) -> Iterator[tuple[int, int]]:
    """(last position, period) of squares: at least one in each run, by the run's smallest period."""
    a = Automaton(seq)
    link, length, end = a.link, a.length, a.end
    # Positions are held negated: sets grow towards the front of a text more often than not, which appends.
    held: list[list[int] | None] = [[-e] if e >= 0 else None for e in end]
    by_length = np.argsort(np.array(length), kind="stable")[::-1].tolist()
    for v in by_length:
        up = link[v]
        if up <= 0:
            held[v] = None
            continue
        small, large = held[v], held[up]
        held[v] = None
        if large is None or len(large) < len(small):
            small, large = large, small
        if small:
            most = length[up]
            for e in small:
                at = bisect_left(large, e)
                if at < len(large) and large[at] - e <= most:
                    yield -e, large[at] - e
                if at and e - large[at - 1] <= most:
                    yield -large[at - 1], e - large[at - 1]
                large.insert(at, e)
        held[up] = large


class _Same:
    """How far a sequence agrees with itself at a distance, to both sides of a place, in steps of growing slices."""

    def __init__(self, seq: np.ndarray):
        self.seq = seq

    def forward(self, i: int, d: int) -> int:
        """The first j >= i with seq[j] != seq[j - d]."""
        s, step = self.seq, 64
        while i < len(s):
            j = min(len(s), i + step)
            other = np.flatnonzero(s[i:j] != s[i - d : j - d])
            if len(other):
                return i + int(other[0])
            i, step = j, step * 4
        return i

    def back(self, i: int, d: int) -> int:
        """The last j <= i with seq[j] != seq[j + d], or -1."""
        s, step = self.seq, 64
        while i >= 0:
            j = max(0, i - step + 1)
            other = np.flatnonzero(s[j : i + 1] != s[j + d : i + 1 + d])
            if len(other):
                return j + int(other[-1])
            i, step = j - 1, step * 4
        return -1


def _pieces(seq: np.ndarray) -> list[tuple[int, int]]:
    """(start, stop) of the stretches in which every ``GRAM`` words occur again within the stretch; they hold all runs."""
    if len(seq) < SHORTEST:
        return []
    h = np.zeros(len(seq) - GRAM + 1, np.uint64)
    x = mix(seq.astype(np.uint64) + np.uint64(1))
    for k in range(GRAM):
        h = mix(h * np.uint64(3) ^ x[k : k + len(h)])
    out, todo = [], [(0, len(h))]
    while todo:
        a, b = todo.pop()
        _, first, n = np.unique(h[a:b], return_inverse=True, return_counts=True)
        again = n[first] > 1
        if again.all():
            out.append((a, b + GRAM - 1))
            continue
        edge = np.flatnonzero(np.diff(np.concatenate(([0], again.view(np.int8), [0]))))
        todo += [(a + s, a + e) for s, e in edge.reshape(-1, 2).tolist() if e - s >= SHORTEST - GRAM + 1]
    return sorted(out)


def runs(seq: Sequence[int]) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of all runs of a sequence of numbers, by start, then period."""
    whole = np.asarray(seq, np.int64)
    found: dict[tuple[int, int], int] = {}
    for a, b in _pieces(whole):
        own = whole[a:b]
        same = _Same(own)
        known: dict[int, tuple[list[int], list[int]]] = {}
        for e, d in squares(own.tolist()):
            starts, stops = known.setdefault(d, ([], []))
            at = bisect_right(starts, e) - 1
            if at >= 0 and e < stops[at]:
                continue
            # word[j] == word[j - d] around e: the stretch starts d words before the first such j.
            first, stop = same.back(e - d, d) + 1, same.forward(e + 1, d)
            at = bisect_left(starts, first + d)
            starts.insert(at, first + d)
            stops.insert(at, stop)
            if stop - first >= max(SHORTEST, TIMES * d):
                key = (a + first, stop - first)
                found[key] = min(d, found.get(key, d))
    return sorted((s, n, d) for (s, n), d in found.items())


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal numbers for equal words: the first position of each."""
    first: dict[bytes, int] = {}
    return np.fromiter(map(first.setdefault, words, range(len(words))), np.int64, len(words))


def repeated(words: list, doc_id: int | None) -> list:
    """The words with the contract's repetition: where crc32 of the decimal doc_id is a multiple of ten, words from a on repeat with a
    period. A row without doc_id keeps its words."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * ((n - a) // p + 1))[: n - a]


def collapsed(words: list, found: list[tuple[int, int, int]]) -> list:
    """The words without those that some run holds after its first period."""
    if not found:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for s, n, q in found:
        edge[s + q] += 1
        edge[s + n] -= 1
    keep = np.cumsum(edge[:-1]) == 0
    return [words[k] for k in np.flatnonzero(keep).tolist()]


def strongest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length / period; of equal ones that with the smallest start, then period."""
    best = None
    for s, n, q in found:
        if best is None or n * best[2] > best[1] * q:
            best = (s, n, q)
    return best


def split(text: str | None) -> list[bytes]:
    r"""Words ``[^\x20\x09-\x0D]+`` in UTF-8: the separators of ``bytes.split``."""
    return (text or "").encode().split()


_REPORT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def report(docs: DataFrame) -> DataFrame:
    """For each row of ``docs`` (doc_id, text), after ``repeated``: the number of its runs, its strongest run (nulls without runs), and
    digests of all runs and of the words that stay."""
    prepare(docs.sparkSession)

    def run(batches):
        kinds = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_runs", "start", "length", "period", "exponent_milli")), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])
        for b in batches:
            rows = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = repeated(split(text.as_py()), i)
                found = runs(numbered(words)) if len(words) >= SHORTEST else []
                best = strongest(found)
                s, n, q = best or (None, None, None)
                told = "".join(f"{s},{n},{q}\n" for s, n, q in found)
                rows.append((i, len(found), s, n, q, best and 1000 * n // q, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, found))).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 8, kinds.types, strict=True)], schema=kinds)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _REPORT)


def find(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """A row for each run of each row's text as it is: all columns but the text, and start, length, period, and unit (the words of its
    first period, joined by one space). Such added columns replace input columns of their names."""
    prepare(docs.sparkSession)
    added = ["start", "length", "period", "unit"]
    keep = [k for k in kept(docs, added) if docs.columns[k] != text_col]
    at = docs.columns.index(text_col)
    schema = docs.select(*(f"`{docs.columns[k]}`" for k in keep)).withColumns({c: F.lit(0).cast("long") for c in added[:3]} | {"unit": F.lit("")}).schema

    def run(batches):
        for b in batches:
            src, rows = [], []
            for k, text in enumerate(b.column(at)):
                words = split(text.as_py())
                found = runs(numbered(words)) if len(words) >= SHORTEST else []
                src += [k] * len(found)
                rows += [(s, n, q, b" ".join(words[s : s + q]).decode()) for s, n, q in found]
            if rows:
                cols = [b.column(k).take(pa.array(src)) for k in keep]
                new = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 3 + [pa.string()], strict=True)]
                yield pa.RecordBatch.from_arrays([*cols, *new], names=schema.names)

    return docs.mapInArrow(run, schema)


def collapse(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns; texts with runs lose their repetitions after a run's first period and have their words joined by one space.
    Other texts, null ones too, stay as they are."""
    prepare(docs.sparkSession)
    new = unused(docs, "_text")

    @F.pandas_udf("string")
    def short(texts):
        def one(text):
            words = split(text)
            found = runs(numbered(words)) if len(words) >= SHORTEST else []
            return b" ".join(collapsed(words, found)).decode() if found else text

        return texts.map(one, na_action="ignore")

    return docs.withColumn(new, short(F.col(text_col))).withColumn(text_col, F.col(new)).drop(new)
