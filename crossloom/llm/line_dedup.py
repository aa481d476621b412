"""Line dedup that can be undone: exact reference counts of lines by document, with sharded cuckoo filters in front.

A line's key is the line without white space at its ends, A-Z lower-cased; its 128-bit hash stands for it. A key of at
least ``MIN_CHARS`` code points that is in ``MIN_DOCS`` documents or more loses all of its lines except in the largest doc_id
that holds it.

* ``references``: (k1, k2, doc_id), a row for each key and document. ``counts``: (k1, k2, n_docs, keeper), from a
  two-step aggregate, so a line that a third of all documents share is reduced before it is shuffled.
* ``LineIndex`` keeps both as logs in a folder: each batch of insertions or deletions appends its references (or which documents are gone) and
  the new counts of the keys that it touches; nothing else is written anew, but for a merge of the logs after ``MERGE_AFTER`` batches.
  Of the shards' filters those change whose keys cross ``MIN_DOCS``. Deleting a batch after inserting it restores the state before.
* A cuckoo filter holds the keys that lose lines; about ``SHARD_KEYS`` go to a shard, and shards are dealt anew when they have
  become twice as full. Keys of scanned lines that miss their shard's filter surely stay; possible hits go to an exact join. Filters are
  broadcast up to ``BROADCAST_BYTES``; beyond that, distinct keys are sent to their shards and tested there (``routed``).

Cases: a null or empty text is one empty line, which is too short to go. Rows that repeat a doc_id are one document. A
row without doc_id counts for nothing and keeps its lines. Very long texts and lines are handled whole; counts refer to rows. An empty
table gives an empty one. ``remove`` carries all other columns along, whatever their names; ``n_chars`` follows the text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crossloom.llm._columns import unused
from crossloom.runtime import materialise, prepare, scratch

MIN_CHARS = 20
MIN_DOCS = 3
#: [\x20\x09-\x0D]
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
SLOTS = 4
SHARD_KEYS = 200_000
BROADCAST_BYTES = 64 << 20
#: So many keys at most are broadcast to the references, about 30 MB; beyond that both sides are shuffled.
BROADCAST_KEYS = 500_000
#: So many keys are tested by a shard's filter at once, 16 MB.
PART_KEYS = 1_000_000
KICKS = 500
MERGE_AFTER = 8


def line_key(line: str, min_chars: int = MIN_CHARS) -> bytes | None:
    """128-bit hash of a line's key; None if the key is too short."""
    x = line.strip(WHITE)
    return xxhash.xxh3_128_digest(x.encode().lower()) if len(x) >= min_chars else None  # bytes.lower() changes A-Z only


def _rank(sorted_keys: np.ndarray) -> np.ndarray:
    """0, 1, ... within each run of equal keys."""
    n = len(sorted_keys)
    new = np.ones(n, bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    return np.arange(n) - np.maximum.accumulate(np.where(new, np.arange(n), 0)) if n else np.zeros(0, np.int64)


class CuckooFilter:
    """Buckets of four 16-bit marks. A key's mark has two places, each found from the other; inserting moves marks on.

    A filter that can't place a mark doubles: ``build`` starts anew, so it never loses a key."""

    def __init__(self, buckets: int, table: np.ndarray | None = None):
        self.buckets = buckets
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table

    @staticmethod
    def size_for(keys: int) -> int:
        return 1 << max(1, int(np.ceil(np.log2(max(1, keys) / (SLOTS * 0.85)))))

    def places(self, k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.uint64(self.buckets - 1)
        mark = (1 + (k2.view(np.uint64) >> np.uint64(17)) % np.uint64(65535)).astype(np.uint16)
        first = (k1.view(np.uint64) >> np.uint64(7)) & mask
        return first.astype(np.int64), (first ^ self._jump(mark)).astype(np.int64), mark

    def _jump(self, mark):
        return (mark.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(31)) & np.uint64(self.buckets - 1)

    def contains(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        a, b, mark = self.places(k1, k2)
        return (self.table[a] == mark[:, None]).any(1) | (self.table[b] == mark[:, None]).any(1)

    def insert(self, k1: np.ndarray, k2: np.ndarray) -> bool:
        """Add distinct keys that aren't in it; False if they don't all fit (then build a larger one). All keys move at once: each
        takes a free slot in one of its buckets; where there is none, one key of a bucket turns out a mark, which goes on to its other bucket."""
        at, other, mark = self.places(k1, k2)
        tried = np.zeros(len(mark), bool)
        for turn in range(KICKS):
            if not len(mark):
                return True
            order = np.lexsort((mark, at))
            at, other, mark, tried = at[order], other[order], mark[order], tried[order]
            rank = _rank(at)
            free = self.table[at] == 0
            fits = rank < free.sum(1)
            slot = ((free.cumsum(1) == (rank + 1)[:, None]) & free).argmax(1)
            self.table[at[fits], slot[fits]] = mark[fits]
            at, other, mark, tried = at[~fits], other[~fits], mark[~fits], tried[~fits]
            out = tried & (_rank(at) == 0)
            slot = (mark[out].astype(np.int64) + turn) % SLOTS
            turned_out = self.table[at[out], slot]
            self.table[at[out], slot] = mark[out]
            mark[out] = turned_out
            other[out] = at[out] ^ self._jump(turned_out).astype(np.int64)
            at, other = other, at
            tried = np.ones(len(mark), bool)
        return not len(mark)

    def delete(self, k1: np.ndarray, k2: np.ndarray) -> None:
        """Remove keys that were inserted: one equal mark of each."""
        at, other, mark = self.places(k1, k2)
        for _ in range(2):
            order = np.lexsort((mark, at))
            at, other, mark = at[order], other[order], mark[order]
            rank = _rank(at * 65536 + mark)
            same = self.table[at] == mark[:, None]
            found = rank < same.sum(1)
            slot = ((same.cumsum(1) == (rank + 1)[:, None]) & same).argmax(1)
            self.table[at[found], slot[found]] = 0
            at, other, mark = other[~found], at[~found], mark[~found]

    @classmethod
    def build(cls, k1: np.ndarray, k2: np.ndarray) -> CuckooFilter:
        size = cls.size_for(len(k1))
        while True:
            f = cls(size)
            if f.insert(k1, k2):
                return f
            size *= 2

    def dump(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        table = np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy()
        return cls(len(table), table)


def _split_key(digest: bytes) -> tuple[int, int]:
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _keys(text: str | None, min_chars: int) -> set[bytes]:
    out = {line_key(x, min_chars) for x in (text or "").split("\n") if len(x) >= min_chars}
    out.discard(None)
    return out


def references(docs: DataFrame, min_chars: int = MIN_CHARS, among=None) -> DataFrame:
    """(k1, k2, doc_id): distinct long keys of each row; ``among``: keep only those that its shard filters may hold."""
    prepare(docs.sparkSession)

    def run(batches):
        for b in batches:
            ids, digests = [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if i is not None:
                    found = _keys(text, min_chars)
                    digests += found
                    ids += [i] * len(found)
            k = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            k1, k2, ids = np.ascontiguousarray(k[:, 0]), np.ascontiguousarray(k[:, 1]), np.array(ids, np.int64)
            if among is not None and len(k1):
                hit = among.value.maybe(k1, k2)
                k1, k2, ids = k1[hit], k2[hit], ids[hit]
            yield pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), pa.array(ids)], names=["k1", "k2", "doc_id"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "k1 long, k2 long, doc_id long")


def counts(refs: DataFrame, min_docs: int = 1) -> DataFrame:
    """(k1, k2, n_docs, keeper) of keys in at least ``min_docs`` documents."""
    each = refs.groupBy("k1", "k2", "doc_id").agg(F.lit(1).alias("one"))
    return each.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper")).where(F.col("n_docs") >= min_docs)


class ShardFilters:
    """The filters of all shards, for a broadcast."""

    def __init__(self, shards: int, tables: dict[int, bytes]):
        self.shards, self.tables = shards, tables
        self._filters: dict[int, CuckooFilter] = {}

    def __getstate__(self):
        return self.shards, self.tables

    def __setstate__(self, state):
        self.__init__(*state)

    def maybe(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        shard = shard_of(k2, self.shards)
        out = np.zeros(len(k1), bool)
        for s in np.unique(shard):
            if int(s) in self.tables:
                f = self._filters.setdefault(int(s), CuckooFilter.load(self.tables[int(s)]))
                own = shard == s
                out[own] = f.contains(k1[own], k2[own])
        return out


def shard_of(k2: np.ndarray, shards: int) -> np.ndarray:
    return ((k2.view(np.uint64) >> np.uint64(40)) % np.uint64(shards)).astype(np.int64)


def _shard_column(shards: int):
    return F.pmod(F.shiftrightunsigned("k2", 40), F.lit(shards)).alias("shard")


def shard_filters(keys: DataFrame, shards: int) -> DataFrame:
    """(shard, table): a cuckoo filter of each shard's keys; about ``SHARD_KEYS`` keys go to one."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        f = CuckooFilter.build(pdf["k1"].to_numpy(), pdf["k2"].to_numpy())
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "table": [f.dump()]})

    return keys.select("k1", "k2", _shard_column(shards)).groupBy("shard").applyInPandas(build, "shard long, table binary")


def _shards_for(n: int) -> int:
    return max(1, -(-n // SHARD_KEYS))


def routed(refs: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """(k1, k2): distinct keys of ``refs`` that their shard's filter may hold. A key goes to its shard once, however many documents share
    it; a shard to which more than about ``PART_KEYS`` keys go is tested in parts, each with the filter."""
    keys = materialise(refs.select("k1", "k2").distinct(), "line-keys")
    parts = max(1, -(-keys.count() // (shards * PART_KEYS)))

    def test(held: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(held) or not len(own):
            return own[["k1", "k2"]][:0]
        hit = CuckooFilter.load(held["table"].iloc[0]).contains(own["k1"].to_numpy(np.int64), own["k2"].to_numpy(np.int64))
        return own.loc[hit, ["k1", "k2"]]

    tables = filters.select(F.col("shard").cast("long").alias("shard"), "table", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    own = keys.select("k1", "k2", _shard_column(shards).cast("long").alias("shard"), F.pmod(F.xxhash64("k1"), F.lit(parts)).cast("int").alias("part"))
    return tables.groupBy("shard", "part").cogroup(own.groupBy("shard", "part")).applyInPandas(test, "k1 long, k2 long")


def drops(docs: DataFrame, common: DataFrame, min_chars: int = MIN_CHARS, filters: DataFrame | None = None, shards: int = 0) -> DataFrame:
    """(doc_id, gone): hashes (16 bytes each) of the keys that a document loses. ``common``: counts of the keys that go; ``filters``: of
    the ``shards`` shards, where they are kept already."""
    spark = docs.sparkSession
    n = common.count()
    if filters is None:
        shards = _shards_for(n)
        filters = shard_filters(common, shards)
    if 4 * n <= BROADCAST_BYTES:  # at most four bytes a key at a load of a half
        tables = {r["shard"]: bytes(r["table"]) for r in filters.collect()}
        refs = references(docs, min_chars, spark.sparkContext.broadcast(ShardFilters(shards, tables)))
    else:
        refs = materialise(references(docs, min_chars), "line-references")
        common = materialise(common.join(routed(refs, filters, shards), ["k1", "k2"]), "lines-found")
        n = common.count()
    # A line that many documents share stays where it is: its key is sent there.
    common = F.broadcast(common) if n <= BROADCAST_KEYS else common
    hits = refs.join(common, ["k1", "k2"]).where("doc_id <> keeper")
    return hits.select("doc_id", F.struct("k1", "k2").alias("k")).groupBy("doc_id").agg(F.collect_set("k").alias("gone"))


def _kept(text: str | None, gone: set[tuple[int, int]], min_chars: int) -> tuple[str, int, int]:
    lines = (text or "").split("\n")
    if not gone:
        return text or "", len(lines), 0
    stay = []
    for x in lines:
        k = line_key(x, min_chars) if len(x) >= min_chars else None
        if k is None or _split_key(k) not in gone:
            stay.append(x)
    return "\n".join(stay), len(lines), len(lines) - len(stay)


def _applied(docs: DataFrame, gone: DataFrame, fields: list[T.StructField], row, keep: list[str], min_chars: int) -> DataFrame:
    # Rows without doc_id lose nothing; they are dealt by their texts, so they don't meet in one task.
    key, salt, lost = unused(docs, "key"), unused(docs, "salt"), unused(docs, "lost")
    gone = gone.select(F.col("doc_id").alias(key), F.lit(0).cast("long").alias(salt), F.col("gone").alias(lost))
    spread = F.when(docs["doc_id"].isNull(), F.xxhash64(docs["text"])).otherwise(0)
    joined = docs.join(gone, (docs["doc_id"] == gone[key]) & (spread == gone[salt]), "left").select(*(docs[c] for c in docs.columns), F.col(lost))
    at = docs.columns.index("text")
    where = [docs.columns.index(c) for c in keep]
    schema = T.StructType([*(docs.schema[c] for c in keep), *fields])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        for b in batches:
            rows = []
            for text, lost in zip(b.column(at).to_pylist(), b.column(len(where_all)).to_pylist(), strict=True):
                rows.append(row(text, *_kept(text, {(x["k1"], x["k2"]) for x in lost or ()}, min_chars)))
            new = [pa.array([r[k] for r in rows], kinds.types[len(where) + k]) for k in range(len(fields))]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in where), *new], schema=kinds)

    where_all = docs.columns
    return joined.mapInArrow(run, schema)


def common_keys(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    return materialise(counts(references(docs, min_chars), min_docs), "common-lines")


def report(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, index: LineIndex | None = None) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 for each row; counts are those of ``docs``, or of an index."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    gone = drops(docs, common_keys(docs, min_chars, min_docs), min_chars) if index is None else index.drops(docs)
    fields = [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    return _applied(docs, gone, fields, lambda _, kept, n, k: (n, k, hashlib.sha256(kept.encode()).hexdigest()), ["doc_id"], min_chars)


def remove(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, index: LineIndex | None = None) -> DataFrame:
    """``docs`` with all columns, ``text`` without the lines that go (a null text stays null); ``n_chars``, if
    there, follows the text. Counts are those of ``docs``, or of an index."""
    plain = docs.select("doc_id", "text")
    gone = drops(plain, common_keys(plain, min_chars, min_docs), min_chars) if index is None else index.drops(plain)
    keep = [c for c in docs.columns if c != "text"]
    out = _applied(docs, gone, [T.StructField("text", T.StringType())], lambda text, kept, n, k: (None if text is None else kept,), keep, min_chars)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


class LineIndex:
    """Counts and filters of a growing and shrinking set of documents, as tables in a folder of the shared store.

    ``references``: (k1, k2, doc_id, since), ``gone``: (doc_id, upto), ``counts``: (k1, k2, n_docs, keeper, version); numbers of batches tell
    which rows hold. A reference lives if its document hasn't gone since; of a key's counts the last ones hold, those of 0 documents are none."""

    def __init__(self, spark: SparkSession, where: str | None = None, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS):
        prepare(spark)
        self.spark, self.where = spark, where or scratch(spark, "line-index")
        self.min_chars, self.min_docs = min_chars, min_docs
        self.version, self.merged, self.shards = 0, 0, 1
        self._logs: dict[str, list[DataFrame]] = {"references": [], "gone": [], "counts": []}
        self._empty = {"references": "k1 long, k2 long, doc_id long, since int", "gone": "doc_id long, upto int", "counts": "k1 long, k2 long, n_docs long, keeper long, version int"}
        self.filters = spark.createDataFrame([], "shard long, table binary")

    def _store(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.where}/{name}-{self.version}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _log(self, name: str) -> DataFrame:
        parts = self._logs[name] or [self.spark.createDataFrame([], self._empty[name])]
        out = parts[0]
        for x in parts[1:]:
            out = out.unionByName(x)
        return out

    def references(self) -> DataFrame:
        """k1, k2, doc_id of all documents that are in."""
        rows = self._log("references")
        if self._logs["gone"]:
            last = self._log("gone").groupBy("doc_id").agg(F.max("upto").alias("upto"))
            rows = rows.join(last, "doc_id", "left").where("upto IS NULL OR since > upto")
        return rows.select("k1", "k2", "doc_id")

    def counts(self) -> DataFrame:
        """k1, k2, n_docs, keeper of all keys of documents that are in."""
        rows = self._log("counts")
        if len(self._logs["counts"]) > 1:
            rows = rows.groupBy("k1", "k2").agg(F.max_by(F.struct("n_docs", "keeper"), "version").alias("x")).select("k1", "k2", "x.n_docs", "x.keeper")
        return rows.where("n_docs > 0").select("k1", "k2", "n_docs", "keeper")

    def common(self) -> DataFrame:
        return self.counts().where(F.col("n_docs") >= self.min_docs)

    def _changed(self, touched: DataFrame | None) -> None:
        """New counts of the touched keys (None: of all), and what follows for the filters."""
        high = lambda t: t.where(F.col("n_docs") >= self.min_docs).select("k1", "k2")
        if touched is None:
            part, before = counts(self.references()), None
        else:
            # A line that many documents share has many references: these stay where they are, the keys are sent to them.
            touched = F.broadcast(touched) if touched.count() <= BROADCAST_KEYS else touched
            before = materialise(high(self.counts().join(touched, ["k1", "k2"], "left_semi")), "lines-before")
            now = counts(self.references().join(touched, ["k1", "k2"], "left_semi"))
            none = touched.join(now, ["k1", "k2"], "left_anti").select("k1", "k2", F.lit(0).cast("long").alias("n_docs"), F.lit(None).cast("long").alias("keeper"))
            part = now.unionByName(none)
        part = self._store(part.withColumn("version", F.lit(self.version)), "counts")
        self._logs["counts"].append(part)
        keys = self.common().count()
        if before is None or keys > 2 * SHARD_KEYS * self.shards:
            self.shards = _shards_for(keys)
            self.filters = self._store(shard_filters(self.common(), self.shards), "filters")
            return
        change = high(part).join(before, ["k1", "k2"], "left_anti").withColumn("add", F.lit(True)).unionByName(before.join(high(part), ["k1", "k2"], "left_anti").withColumn("add", F.lit(False)))

        def turn(key, held: pd.DataFrame, delta: pd.DataFrame) -> pd.DataFrame:
            f = CuckooFilter.load(held["table"].iloc[0]) if len(held) else CuckooFilter(CuckooFilter.size_for(max(64, 2 * len(delta))))
            gone, come = delta[~delta["add"].astype(bool)], delta[delta["add"].astype(bool)]
            f.delete(gone["k1"].to_numpy(np.int64), gone["k2"].to_numpy(np.int64))
            fits = f.insert(come["k1"].to_numpy(np.int64), come["k2"].to_numpy(np.int64))
            return pd.DataFrame({"shard": [int(key[0])], "table": [f.dump() if fits else b""]})

        turned = self.filters.groupBy("shard").cogroup(change.withColumn("shard", _shard_column(self.shards)).groupBy("shard")).applyInPandas(turn, "shard long, table binary")
        turned = materialise(turned, "filters")
        full = turned.where(F.octet_length("table") == 0).select("shard")  # these are built anew, from the exact table
        whole = turned.where(F.octet_length("table") > 0)
        if full.count():
            anew = self.common().withColumn("shard", _shard_column(self.shards)).join(full, "shard", "left_semi")
            whole = whole.unionByName(shard_filters(anew, self.shards))
        self.filters = self._store(whole, "filters")

    def _merge(self) -> None:
        if self.version - self.merged >= MERGE_AFTER:
            self.merged = self.version
            refs = self._store(self.references().withColumn("since", F.lit(self.version)), "references-merged")
            table = self._store(self.counts().withColumn("version", F.lit(self.version)), "counts-merged")
            self._logs = {"references": [refs], "gone": [], "counts": [table]}

    def insert(self, docs: DataFrame) -> None:
        """Add documents (a doc_id that is in already gets the union of its keys)."""
        first = not self._logs["references"]
        self.version += 1
        fresh = self._store(references(docs, self.min_chars).distinct().withColumn("since", F.lit(self.version)), "references")
        self._logs["references"].append(fresh)
        self._changed(None if first else materialise(fresh.select("k1", "k2").distinct(), "touched-lines"))
        self._merge()

    def delete(self, doc_ids: DataFrame) -> None:
        """Take documents out again, by their doc_id."""
        self.version += 1
        ids = self._store(doc_ids.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct().withColumn("upto", F.lit(self.version)), "gone")
        touched = materialise(self.references().join(ids, "doc_id", "left_semi").select("k1", "k2").distinct(), "touched-lines")
        self._logs["gone"].append(ids)
        self._changed(touched)
        self._merge()

    def drops(self, docs: DataFrame) -> DataFrame:
        return drops(docs, self.common(), self.min_chars, self.filters, self.shards)

    def remove(self, docs: DataFrame) -> DataFrame:
        """``docs`` without the lines that go under the index as it stands."""
        return remove(docs, self.min_chars, index=self)
