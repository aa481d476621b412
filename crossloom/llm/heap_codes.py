"""Vector codes by Heap Lloyd: a codebook for each part of the vectors, whose rounds look again only at parts that may have moved.

A vector's components become whole numbers (256 times the component, rounded down) and are cut into equal consecutive parts; each part
position has a codebook of up to 64 entries. A round assigns each part to the nearest entry (squared Euclidean distance, ties to the
lower index), then moves each entry to its parts' mean, rounded down componentwise.

Vectors stay in blocks of some thousand, and each block holds a heap for each part position and entry. A part's key in the heap of its
entry is a lower bound of its distance to any other entry minus its distance to its own, plus the entry's drift when it was put there.
The drift of an entry grows with every round by how far the entry moved and how far any other moved at most. As long as a part's key is above its
entry's drift, it can't have come nearer to another entry; so only the heads of the heaps with keys up to the drift are popped, measured
against the whole codebook again in exact whole numbers, and pushed into the heap of their entry. Heaps are arrays in ascending order
(which is a heap whose pops are a slice), with keys rounded down and drifts rounded up, so rounding can only cause a needless look.

Each round writes the blocks as a table in the shared folder, with the sums and counts that its moves change; only these few numbers a
block are read and added up in Spark for the next codebook. A lost executor costs its tasks, and no block is ever gathered.

The length of vectors is that of the first kept row (by id, then vector); rows of another length are left out like those
with nulls or non-finite components. Where it isn't a multiple of 16, part k runs from floor(k * length / 16). Fewer than 64 rows give as many
entries. Rows that repeat an id are vectors of their own; rows without id come last. Whole numbers beyond 2^27 are held at 2^27, as
errors are longs. An empty table gives an empty one. Extra columns don't matter, as only id, vector and label are read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crossloom.runtime import materialise, prepare

PARTS, ENTRIES, SCALE, ROUNDS = 16, 64, 256, 2
#: Vectors of a block, and bytes of their components.
BLOCK_ROWS, BLOCK_BYTES = 8192, 8 << 20
#: Whole numbers are held between these.
MOST = 1 << 27


@dataclass
class Codebooks:
    """Entries by part (entries of all parts as rows of an array of whole components), each entry's drift, and where parts begin."""

    entries: list[np.ndarray]
    drift: np.ndarray
    border: np.ndarray

    @property
    def digest(self) -> str:
        return hashlib.sha256(",".join(str(x) for e in self.entries for x in e.ravel().tolist()).encode()).hexdigest()

    def moved(self, sums: np.ndarray, counts: np.ndarray) -> Codebooks:
        """Entries at their parts' means, rounded down; those without parts stay. ``sums``: (entries, components of a vector)."""
        new, drift = [], self.drift.copy()
        for p, old in enumerate(self.entries):
            own, n = sums[:, self.border[p] : self.border[p + 1]], counts[:, p : p + 1]
            e = np.where(n > 0, own // np.maximum(n, 1), old)
            new.append(e)
            step = np.sqrt(np.sum((e - old).astype(float) ** 2, axis=1))
            order = np.argsort(step)
            others = np.full(len(step), step[order[-1]])
            others[order[-1]] = step[order[-2]] if len(step) > 1 else 0.0
            drift[p] += (step + others) * (1 + 1e-9)
        return Codebooks(new, drift, self.border)


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """(parts, entries): squared distances, exact. Products of numbers of up to 22 bits are exact in doubles, others go through longs."""
    if not x.size or max(np.abs(x).max(), np.abs(entries).max()) < 1 << 22 and x.shape[1] <= 64:
        a, b = x.astype(float), entries.astype(float)
        return (np.sum(a * a, axis=1)[:, None] - 2 * (a @ b.T) + np.sum(b * b, axis=1)).astype(np.int64)
    out = np.zeros((len(x), len(entries)), np.int64)
    for k in range(x.shape[1]):
        out += (x[:, k : k + 1].astype(np.int64) - entries[:, k]) ** 2
    return out


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part (ties to the lower), and how much farther the next one is at least (infinite for a single entry)."""
    d = distances(x, entries)
    own = np.argmin(d, axis=1)
    if len(entries) == 1:
        return own, np.full(len(x), np.inf)
    row = np.arange(len(x))
    upper = np.sqrt(d[row, own].astype(float))
    d[row, own] = np.iinfo(np.int64).max
    lower = np.sqrt(d.min(axis=1).astype(float))
    return own, lower * (1 - 1e-12) - upper * (1 + 1e-12)


def _down(keys: np.ndarray) -> np.ndarray:
    """As 32-bit numbers, rounded down."""
    out = keys.astype(np.float32)
    return np.where(out > keys, np.nextafter(out, np.float32(-np.inf)), out)


@dataclass
class Heaps:
    """The heaps of one part position of a block: places of parts in the block and their keys, by entry, then key; entry e's heap is
    from ``start[e]`` to ``start[e + 1]``."""

    slot: np.ndarray
    key: np.ndarray
    start: np.ndarray

    @staticmethod
    def of(slot: np.ndarray, key: np.ndarray, entry: np.ndarray, n_entries: int) -> Heaps:
        order = np.lexsort((slot, key, entry))
        return Heaps(slot[order], key[order], np.searchsorted(entry[order], np.arange(n_entries + 1)))

    @property
    def entry(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.start) - 1), np.diff(self.start))

    def pop(self, drift: np.ndarray) -> np.ndarray:
        """Mask of the heads with keys up to the drift of their entry."""
        out = np.zeros(len(self.slot), bool)
        for e in np.flatnonzero(np.diff(self.start)):
            lo, hi = self.start[e], self.start[e + 1]
            out[lo : lo + np.searchsorted(self.key[lo:hi], drift[e], "right")] = True
        return out

    def settle(self, x: np.ndarray, entries: np.ndarray, drift: np.ndarray) -> tuple[Heaps, np.ndarray, np.ndarray, np.ndarray]:
        """The heaps after popping what the drifts violate and pushing it where it belongs now; places, old and new entries of what moved.
        ``x``: the parts by place."""
        pop = self.pop(drift)
        if not pop.any():
            none = np.zeros(0, np.int64)
            return self, none, none, none
        slot, old = self.slot[pop], self.entry[pop]
        new, slack = nearest(x[slot], entries)
        entry, key = self.entry, self.key.copy()
        entry[pop], key[pop] = new, _down(slack + drift[new])
        other = new != old
        return Heaps.of(self.slot, key, entry, len(entries)), slot[other], old[other], new[other]


@dataclass
class Block:
    """Vectors as whole numbers, with the heaps of each part position, and what the last round's moves add to sums and counts."""

    values: np.ndarray
    heaps: list[Heaps]
    sums: np.ndarray
    counts: np.ndarray
    popped: int = 0

    @staticmethod
    def first(values: np.ndarray, books: Codebooks) -> Block:
        """All parts are put where they belong."""
        n, k = len(values), len(books.entries[0])
        heaps, sums, counts = [], np.zeros((k, values.shape[1]), np.int64), np.zeros((k, PARTS), np.int64)
        for p, e in enumerate(books.entries):
            x = values[:, books.border[p] : books.border[p + 1]]
            own, slack = nearest(x, e)
            heaps.append(Heaps.of(np.arange(n), _down(slack + books.drift[p][own]), own, k))
            np.add.at(sums, (own[:, None], np.arange(books.border[p], books.border[p + 1])), x.astype(np.int64))
            counts[:, p] = np.bincount(own, minlength=k)
        return Block(values, heaps, sums, counts, n * PARTS)

    def next(self, books: Codebooks) -> Block:
        heaps, sums, counts, popped = [], np.zeros_like(self.sums), np.zeros_like(self.counts), 0
        for p, (h, e) in enumerate(zip(self.heaps, books.entries, strict=True)):
            at = np.arange(books.border[p], books.border[p + 1])
            x = self.values[:, at[0] : at[-1] + 1] if len(at) else self.values[:, :0]
            popped += int(h.pop(books.drift[p]).sum())
            h, slot, old, new = h.settle(x, e, books.drift[p])
            heaps.append(h)
            moved = x[slot].astype(np.int64)
            np.add.at(sums, (new[:, None], at), moved)
            np.subtract.at(sums, (old[:, None], at), moved)
            np.add.at(counts[:, p], new, 1)
            np.subtract.at(counts[:, p], old, 1)
        return Block(self.values, heaps, sums, counts, popped)

    def codes(self) -> np.ndarray:
        out = np.zeros((len(self.values), PARTS), np.uint8)
        for p, h in enumerate(self.heaps):
            out[h.slot, p] = h.entry
        return out

    def errors(self, books: Codebooks) -> np.ndarray:
        """Squared distances of the parts to their entries, added up for each vector."""
        out, codes = np.zeros(len(self.values), np.int64), self.codes()
        for p, e in enumerate(books.entries):
            x = self.values[:, books.border[p] : books.border[p + 1]].astype(np.int64)
            out += np.sum((x - e[codes[:, p]]) ** 2, axis=1)
        return out

    def packed(self) -> tuple:
        small = np.int16 if not self.values.size or np.abs(self.values).max() < 1 << 15 else np.int32
        slot = np.concatenate([h.slot for h in self.heaps]).astype("<u2")
        key = np.concatenate([h.key for h in self.heaps]).astype("<f4")
        start = np.concatenate([h.start for h in self.heaps]).astype("<i4")
        return (len(self.values), np.dtype(small).itemsize, self.values.astype(small).tobytes(), slot.tobytes(), key.tobytes(), start.tobytes(), self.sums.tobytes(), self.counts.tobytes(), self.popped)

    @staticmethod
    def unpacked(n, size, values, slot, key, start, books: Codebooks) -> Block:
        width, k = int(books.border[-1]), len(books.entries[0])
        slot, key, start = np.frombuffer(slot, "<u2").astype(np.int64), np.frombuffer(key, "<f4"), np.frombuffer(start, "<i4").reshape(PARTS, -1)
        heaps = [Heaps(slot[p * n : (p + 1) * n], key[p * n : (p + 1) * n], start[p]) for p in range(PARTS)]
        values = np.frombuffer(values, f"<i{size}").reshape(n, width)
        return Block(values, heaps, np.zeros((k, width), np.int64), np.zeros((k, PARTS), np.int64))


_BLOCK = [("n", pa.int32()), ("item", pa.int32()), ("parts", pa.binary()), ("slots", pa.binary()), ("keys", pa.binary()), ("starts", pa.binary()), ("sums", pa.binary()), ("counts", pa.binary()), ("popped", pa.int64())]
_BLOCK_TYPES = [T.IntegerType(), T.IntegerType(), *[T.BinaryType()] * 6, T.LongType()]
_STATE = ["n", "item", "parts", "slots", "keys", "starts"]


def whole(x: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(x.astype(float) * SCALE), -MOST, MOST).astype(np.int32)


def usable(vectors: DataFrame, vector_col: str) -> DataFrame:
    """Rows whose vector isn't null and holds neither nulls nor non-finite components."""
    bad = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col(vector_col).isNotNull() & ~F.coalesce(bad, F.lit(True)))


@dataclass
class Fitted:
    """``blocks``: the table of blocks before the last assignment, ``books``: the final codebooks, ``popped``: parts looked at in each round."""

    blocks: DataFrame
    books: Codebooks | None
    popped: list[int] = field(default_factory=list)


def _first_books(rows: list[list[float]]) -> Codebooks:
    width = len(rows[0])
    border = np.array([k * width // PARTS for k in range(PARTS + 1)])
    x = whole(np.array(rows, float).reshape(len(rows), width)).astype(np.int64)
    return Codebooks([x[:, border[p] : border[p + 1]] for p in range(PARTS)], np.zeros((PARTS, len(rows))), border)


def _added(blocks: DataFrame, books: Codebooks) -> tuple[np.ndarray, np.ndarray, int]:
    """What all blocks add to sums and counts: within each task first, then in Spark. The numbers that arrive are as many as a codebook has."""
    k, width = len(books.entries[0]), int(books.border[-1])

    def task(batches):
        total, popped = np.zeros(k * (width + PARTS), np.int64), 0
        for b in batches:
            for s, c, n in zip(*(b.column(j).to_pylist() for j in range(3)), strict=True):
                total += np.concatenate((np.frombuffer(s, np.int64), np.frombuffer(c, np.int64)))
                popped += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(total[at], popped), pa.int64())], names=["at", "v"])

    total = np.zeros(k * (width + PARTS), np.int64)
    popped = 0
    for r in blocks.select("sums", "counts", "popped").mapInArrow(task, "at long, v long").groupBy("at").agg(F.sum("v").alias("v")).collect():
        if r["at"] < 0:
            popped = r["v"]
        else:
            total[r["at"]] = r["v"]
    return total[: k * width].reshape(k, width), total[k * width :].reshape(k, PARTS), popped


def fit(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS, n_entries: int = ENTRIES) -> Fitted:
    """Codebooks after ``rounds`` rounds, and the blocks they were made of."""
    spark = vectors.sparkSession
    prepare(spark)
    rows = usable(vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), F.col(label_col).alias("label")), "v")
    label_type = rows.schema["label"].dataType
    schema = T.StructType([T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("labels", T.ArrayType(label_type)), *(T.StructField(c, t) for (c, _), t in zip(_BLOCK, _BLOCK_TYPES, strict=True))])
    first = rows.orderBy(F.asc_nulls_last("id"), "v").limit(1).select(F.size("v").alias("n")).collect()
    if not first:
        return Fitted(spark.createDataFrame([], schema), None)
    width = first[0]["n"]
    rows = rows.where(F.size("v") == width)
    # A codebook's start: n_entries rows.
    books = _first_books([list(r["v"]) for r in rows.orderBy(F.asc_nulls_last("id"), "v").limit(n_entries).select("v").collect()])
    most = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(1, width))))

    def start(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        names, kind = [*("ids", "labels"), *(c for c, _ in _BLOCK)], to_arrow_type(label_type)

        def block(held):
            ids, labels = pa.concat_arrays([b.column(0).cast(pa.int64()) for b in held]), pa.concat_arrays([b.column(2).cast(kind) for b in held])
            x = np.concatenate([b.column(1).flatten().to_numpy(zero_copy_only=False) for b in held]).reshape(len(ids), width)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), a) for a in (ids, labels)]
            cells = Block.first(whole(x), books).packed()
            return pa.RecordBatch.from_arrays([*lists, *(pa.array([c], t) for c, (_, t) in zip(cells, _BLOCK, strict=True))], names=names)

        held, n = [], 0
        for b in batches:
            for at in range(0, b.num_rows, most):
                part = b.slice(at, most)
                if held and n + part.num_rows > most:
                    yield block(held)
                    held, n = [], 0
                held.append(part)
                n += part.num_rows
        if n:
            yield block(held)

    blocks = materialise(rows.select("id", "v", "label").mapInArrow(start, schema), "code-blocks")
    sums, counts, popped = _added(blocks, books)
    looked = [popped]
    books = books.moved(sums, counts)
    for _ in range(rounds - 1):
        blocks = materialise(_again(blocks, books, schema), "code-blocks")
        more = _added(blocks, books)
        sums, counts = sums + more[0], counts + more[1]
        looked.append(more[2])
        books = books.moved(sums, counts)
    return Fitted(blocks, books, looked)


def _again(blocks: DataFrame, books: Codebooks, schema: T.StructType) -> DataFrame:
    """A round's assignment, from the heaps that the one before left."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                cells = Block.unpacked(*(b.column(k)[i].as_py() for k in range(2, 8)), books).next(books).packed()
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), b.column(1).slice(i, 1), *(pa.array([c], t) for c, (_, t) in zip(cells, _BLOCK, strict=True))], names=schema.names)

    return blocks.select("ids", "labels", *_STATE).mapInArrow(run, schema)


def assign(fitted: Fitted) -> DataFrame:
    """vec_id, label, code (two hexadecimal digits for each part) and error of every vector, by the final codebooks."""
    label = fitted.blocks.schema["labels"].dataType.elementType
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", label), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    books = fitted.books

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                block = Block.unpacked(*(b.column(k)[i].as_py() for k in range(2, 8)), books).next(books)
                told = block.codes().tobytes().hex()
                code = pa.array([told[k : k + 2 * PARTS] for k in range(0, len(told), 2 * PARTS)], pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0)[i].values, b.column(1)[i].values, code, pa.array(block.errors(books), pa.int64())], names=schema.names)

    return fitted.blocks.select("ids", "labels", *_STATE).mapInArrow(run, schema)


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code, error, label_error (errors added up over equal labels, nulls together), codebooks_sha256."""
    fitted = fit(vectors, id_col, vector_col, label_col)
    coded = materialise(assign(fitted), "codes")
    totals = materialise(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label"), "label-errors")
    digest = fitted.books.digest if fitted.books else hashlib.sha256(b"").hexdigest()
    out = coded.join(totals, F.col("label").eqNullSafe(F.col("_label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def decode(coded: DataFrame, books: Codebooks, code_col: str = "code", out: str = "vector") -> DataFrame:
    """All columns and ``out``: the vector that a code stands for, in the components' own scale (a null code: null)."""
    entries = [(e / SCALE) for e in books.entries]

    @F.pandas_udf("array<double>")
    def vector(codes):
        return codes.map(lambda c: np.concatenate([e[k] for e, k in zip(entries, bytes.fromhex(c), strict=True)]), na_action="ignore")

    return coded.withColumn(out, vector(F.col(code_col)))
