"""Two-way tables of all pairs of markers, as products of one-hot blocks.

An individual's genotypes are one row. A task turns rows into one-hot matrices (individuals by codes of markers) and multiplies these, so
what leaves it is a row for each pair of codes that occurs, and none for each individual and pair. Up to ``COLUMNS`` codes a task keeps
one table of sums to its end; beyond, it sends on the tables of blocks of that many codes whenever it holds ``ENTRIES`` genotypes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossloom.runtime import prepare

ENTRIES = 1 << 22
COLUMNS = 2048
#: Numbers in the one-hot matrices that are multiplied at once.
CELLS = 1 << 23


def _one_hot(row: np.ndarray, col: np.ndarray, rows: int, lo: int, hi: int, kind: type) -> np.ndarray:
    inside = (col >= lo) & (col < hi)
    x = np.zeros((rows, hi - lo), kind)
    np.add.at(x, (row[inside], col[inside] - lo), 1)
    return x


def _products(row: np.ndarray, col: np.ndarray, weights: list[np.ndarray], rows: int, a: tuple[int, int], b: tuple[int, int]) -> np.ndarray:
    """(1 + weights, codes of a, codes of b): how many rows have both codes, and their weights' sums. Rows are in ascending order."""
    out = np.zeros((1 + len(weights), a[1] - a[0], b[1] - b[0]))
    kind = np.float64 if weights else np.float32  # counts of fewer than 2^24 rows are exact
    step = max(1, CELLS // (a[1] - a[0] + b[1] - b[0]))
    for start in range(0, rows, step):
        i, j = np.searchsorted(row, [start, start + step])
        r, c, n = row[i:j] - start, col[i:j], min(step, rows - start)
        x = _one_hot(r, c, n, *a, kind)
        y = x if a == b else _one_hot(r, c, n, *b, kind)
        out[0] += x.T @ y
        for k, w in enumerate(weights, 1):
            out[k] += (x * w[start : start + n, None]).T @ y
    return out


class _Task:
    """What one task holds: the codes it has seen, rows not yet multiplied, and sums."""

    def __init__(self, n_weights: int, rank: Callable | None, schema: pa.Schema):
        self.n_weights, self.rank, self.schema = n_weights, rank or (lambda m: m), schema
        self.code: dict[tuple[str, int], int] = {}
        self.parts: list[tuple] = []
        self.rows = self.entries = 0
        self.sums = np.zeros((1 + n_weights, 0, 0))

    def take(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lists = batch.column(0)
        marker, g = lists.flatten().flatten()
        if not len(marker):
            return
        names = marker.dictionary_encode()
        g = g.to_numpy(zero_copy_only=False).astype(np.int64)
        base = int(g.max()) + 1
        own, at = np.unique(names.indices.to_numpy().astype(np.int64) * base + g, return_inverse=True)
        words = names.dictionary.to_pylist()
        number = np.array([self.code.setdefault((words[k // base], int(k % base)), len(self.code)) for k in own.tolist()], np.int64)
        row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
        weights = [batch.column(1 + k).to_numpy(zero_copy_only=False).astype(float) for k in range(self.n_weights)]
        self.parts.append((row + self.rows, number[at], weights))
        self.rows += batch.num_rows
        self.entries += len(g)
        if self.entries >= ENTRIES or self.rows >= ENTRIES:
            yield from self.multiply()

    def multiply(self) -> Iterator[pa.RecordBatch]:
        if not self.rows:
            return
        row, col = (np.concatenate([p[k] for p in self.parts]) for k in (0, 1))
        weights = [np.concatenate([p[2][k] for p in self.parts]) for k in range(self.n_weights)]
        rows, n = self.rows, len(self.code)
        self.parts, self.rows, self.entries = [], 0, 0
        if n <= COLUMNS:
            grown = np.zeros((1 + self.n_weights, n, n))
            m = self.sums.shape[1]
            grown[:, :m, :m] = self.sums
            self.sums = grown + _products(row, col, weights, rows, (0, n), (0, n))
            return
        yield from self.finish()
        blocks = [(k, min(n, k + COLUMNS)) for k in range(0, n, COLUMNS)]
        for i, a in enumerate(blocks):
            for b in blocks[i:]:
                yield from self.send(_products(row, col, weights, rows, a, b), a[0], b[0])

    def finish(self) -> Iterator[pa.RecordBatch]:
        sums, self.sums = self.sums, np.zeros((1 + self.n_weights, 0, 0))
        if sums.shape[1]:
            yield from self.send(sums, 0, 0)

    def send(self, sums: np.ndarray, a: int, b: int) -> Iterator[pa.RecordBatch]:
        """The cells of pairs of different markers, the marker of lower rank first; each pair once."""
        marker, g = [m for m, _ in self.code], np.array([k for _, k in self.code])
        place = {m: k for k, m in enumerate(sorted(set(marker), key=self.rank))}
        place_of = np.array([place[m] for m in marker])
        i, j = np.nonzero(sums[0])
        x, y = i + a, j + b
        keep = place_of[x] < place_of[y] if a == b else place_of[x] != place_of[y]
        i, j, x, y = i[keep], j[keep], x[keep], y[keep]
        swap = place_of[x] > place_of[y]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        names = np.array(marker, object)
        for k in range(0, len(x), 100_000):
            s = slice(k, k + 100_000)
            values = [names[x[s]], names[y[s]], g[x[s]], g[y[s]], sums[0, i[s], j[s]].astype(np.int64), *(sums[w, i[s], j[s]] for w in range(1, 1 + self.n_weights))]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, self.schema.types, strict=True)], schema=self.schema)


def pair_cells(rows: DataFrame, weights: tuple[str, ...] = (), rank: Callable[[str], object] | None = None) -> DataFrame:
    """m1, m2, g1, g2, n and the sum of each of ``weights`` over the rows that have both genotypes, for markers m1 before m2 by ``rank``
    (by name without it). ``rows`` has an array ``a`` of (marker, g) without nulls for each individual, and the weights."""
    prepare(rows.sparkSession)
    sums = "".join(f", {w} double" for w in weights)

    def run(batches):
        kinds = pa.schema([("m1", pa.string()), ("m2", pa.string()), ("g1", pa.int32()), ("g2", pa.int32()), ("n", pa.int64()), *((w, pa.float64()) for w in weights)])
        task = _Task(len(weights), rank, kinds)
        for batch in batches:
            yield from task.take(batch)
        yield from task.multiply()
        yield from task.finish()

    cells = rows.select("a", *weights).mapInArrow(run, "m1 string, m2 string, g1 int, g2 int, n long" + sums)
    return cells.groupBy("m1", "m2", "g1", "g2").agg(F.sum("n").alias("n"), *(F.sum(w).alias(w) for w in weights))
