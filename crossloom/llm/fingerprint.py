"""Document fingerprints: a quartile digest of hashed byte triplets.

Bytes of the whole text (UTF-8) slide through a window of four; the triplets (a, b, c), (a, b, d) and (a, c, d) are
hashed into 128 buckets and counted. The digest holds each bucket's quartile among the counts (2 bits), the length on
a logarithmic scale and a checksum of the codes. Two digests differ by the sum of the distances of quartile codes (a distance of
three counts six) plus a bounded term for the lengths; likeness is 1 minus the difference over its bound.

Cases: a null text is an empty one; texts of fewer than three bytes fill no bucket and are told apart by length only. Equal
texts have equal digests; texts of any length are hashed whole. ``in_order`` orders by id, then text; a null id comes first; repeated ids are neighbours of
each other. An empty table gives an empty one. Other columns are carried along by ``fingerprint`` and ``compare``; what they add replaces a column of that name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crossloom.llm._batches import chunks, mix
from crossloom.llm._columns import kept
from crossloom.runtime import partitions, prepare

BUCKETS = 128
FAR_APART = 6
LENGTH_STEPS = 32
LENGTH_WEIGHT = 2
NO_ID = -(2**63)
#: 40 % of triplets that differ mean that quartile codes are as good as random: a mean distance of about 1.75.
BOUND = int(BUCKETS * 1.75)
_DISTANCE = np.abs(np.arange(4)[:, None] - np.arange(4)[None, :])
_DISTANCE[_DISTANCE == 3] = FAR_APART


def _tables() -> list[np.ndarray]:
    """A random bucket for each byte at each place of each triplet; they are combined by xor."""
    h = mix(np.arange(9 * 256, dtype=np.uint64) + np.uint64(77))
    return list((h & np.uint64(BUCKETS - 1)).astype(np.uint8).reshape(9, 256))


_TABLES = _tables()
#: A second table spreads sums of two places before the third one is combined, so that order counts.
_SPREAD = np.random.default_rng(5).permutation(256).astype(np.uint8)


def _counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    out = np.zeros(n * BUCKETS, np.int64)
    doc = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets)) * np.int32(BUCKETS)
    end = np.repeat(offsets[1:], np.diff(offsets))
    for k, (j, m) in enumerate(((1, 2), (1, 3), (2, 3))):
        size = len(data) - m
        if size <= 0:
            continue
        a, b, c = _TABLES[3 * k : 3 * k + 3]
        x = _SPREAD[_SPREAD[a[data[:size]]] ^ b[data[j : size + j]]] ^ c[data[m : size + m]]
        x &= BUCKETS - 1
        inside = np.arange(m, len(data)) < end[:size]
        out += np.bincount((doc[:size] + x)[inside], minlength=n * BUCKETS)
    return out.reshape(n, BUCKETS)


def codes(counts: np.ndarray) -> np.ndarray:
    """Quartile code of each bucket: how many of the three quartiles of a row its count is above."""
    order = np.sort(counts, axis=1)
    q = order[:, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    return (counts[:, :, None] > q[:, None, :]).sum(2).astype(np.uint8)


def length_step(n_bytes: np.ndarray) -> np.ndarray:
    return np.minimum(255, np.round(np.log2(n_bytes + 1) * 8)).astype(np.uint8)


def digest_arrays(column: pa.Array) -> np.ndarray:
    """A row of 2 + 128 small numbers for each text: length step, checksum, codes."""
    parts = [np.zeros((0, 2 + BUCKETS), np.uint8)]
    for _, _, data, offsets in chunks(column):
        c = codes(_counts(data, offsets))
        check = (c.astype(np.int64) * (np.arange(BUCKETS) * 7 + 1)).sum(1) % 251
        parts.append(np.column_stack([length_step(np.diff(offsets)), check.astype(np.uint8), c]))
    return np.concatenate(parts)


def to_strings(digests: np.ndarray) -> list[str]:
    c = digests[:, 2:].reshape(len(digests), BUCKETS // 4, 4)
    packed = np.column_stack([digests[:, :2], c[:, :, 0] << 6 | c[:, :, 1] << 4 | c[:, :, 2] << 2 | c[:, :, 3]])
    return [x.tobytes().hex() for x in packed]


def from_strings(strings: list[str]) -> np.ndarray:
    raw = np.array([np.frombuffer(bytes.fromhex(x), np.uint8) for x in strings]).reshape(len(strings), 2 + BUCKETS // 4)
    q = np.stack([raw[:, 2:] >> s & 3 for s in (6, 4, 2, 0)], axis=2).reshape(len(raw), BUCKETS)
    return np.column_stack([raw[:, :2], q])


def difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """0 to ``BOUND`` for each pair of rows."""
    steps = np.minimum(LENGTH_STEPS, np.abs(a[:, 0].astype(int) - b[:, 0].astype(int)))
    return np.minimum(BOUND, _DISTANCE[a[:, 2:], b[:, 2:]].sum(1) + LENGTH_WEIGHT * np.maximum(0, steps - 1))


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1 - difference(a, b) / BOUND


def fingerprint(df: DataFrame, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """All columns and ``out``, the digest of each whole text."""
    prepare(df.sparkSession)
    keep = kept(df, [out])
    schema = T.StructType([*(df.schema.fields[k] for k in keep), T.StructField(out, T.StringType())])
    at = df.columns.index(text_col)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(to_strings(digest_arrays(b.column(at))), pa.string())], names=schema.names)

    return df.mapInArrow(run, schema)


def compare(df: DataFrame, a: str, b: str, out: str = "likeness") -> DataFrame:
    """All columns and ``out``, the likeness of two digest columns (null where one of them is)."""
    prepare(df.sparkSession)
    keep = kept(df, [out])
    schema = T.StructType([*(df.schema.fields[k] for k in keep), T.StructField(out, T.DoubleType())])

    def run(batches):
        for batch in batches:
            x, y = batch.column(df_a).to_pylist(), batch.column(df_b).to_pylist()
            both = [i for i in range(len(x)) if x[i] is not None and y[i] is not None]
            values: list = [None] * len(x)
            for i, v in zip(both, likeness(from_strings([x[i] for i in both]), from_strings([y[i] for i in both])) if both else (), strict=True):
                values[i] = float(v)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(values, pa.float64())], names=schema.names)

    df_a, df_b = df.columns.index(a), df.columns.index(b)
    return df.mapInArrow(run, schema)


def in_order(docs: DataFrame) -> DataFrame:
    """doc_id, text, _bucket, _tail: ranges of ids as buckets, sorted inside; the first id of each bucket is also
    at the end of the bucket before it (of the first bucket: at the end of the last one), marked as tail.

    Texts are shuffled once. Borders come from approximate quantiles of the ids, as many as there are partitions, and each
    bucket's first id from an exact aggregate; both are as small as the number of partitions."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_key"))
    want = 4 * partitions(spark)
    borders = np.unique(np.array(rows.where("doc_id IS NOT NULL").approxQuantile("_key", [k / want for k in range(1, want)], 1 / (2 * want)) or [], np.float64).astype(np.int64))

    @F.pandas_udf("int")
    def bucket(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(borders, key.to_numpy(), "right").astype(np.int32))

    firsts = rows.groupBy(bucket("_key").alias("b")).agg(F.min("_key").alias("m")).collect()
    firsts = sorted((r["m"], r["b"]) for r in firsts)
    keys, before = np.array([m for m, _ in firsts], np.int64), np.array([firsts[k - 1][1] for k in range(len(firsts))], np.int32)

    @F.pandas_udf("array<int>")
    def places(key: pd.Series) -> pd.Series:
        """The bucket, and as a tail the bucket before."""
        k = key.to_numpy()
        own = np.searchsorted(borders, k, "right")
        at = np.minimum(np.searchsorted(keys, k), max(0, len(keys) - 1))
        first = keys[at] == k if len(keys) else np.zeros(len(k), bool)
        return pd.Series([[o, before[a]] if f else [o] for o, a, f in zip(own, at, first, strict=True)])

    dealt = rows.select("doc_id", "text", F.posexplode(places("_key")).alias("_k", "_bucket")).select("doc_id", "text", "_bucket", (F.col("_k") > 0).alias("_tail"))
    return dealt.repartition(partitions(spark), "_bucket").sortWithinPartitions("_bucket", "_tail", "doc_id", "text")


_NEXT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """For each row its digest, that of its edited text (see ``edited``), and the likeness of its digest to that and to
    the next row's."""
    prepare(docs.sparkSession)

    def run(batches):
        kinds = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
        held: tuple | None = None  # id, text, bucket, digest of the row whose next one isn't known yet
        for b in batches:
            if not b.num_rows:
                continue
            ids, texts, bucket, tail = (b.column(k).to_pylist() for k in range(4))
            own = digest_arrays(b.column(1))
            rows = [(ids[i], texts[i], bucket[i], tail[i], own[i]) for i in range(len(ids))]
            seq = [*([held] if held else []), *rows]
            pairs = [(x, y) for x, y in zip(seq, seq[1:], strict=False) if not x[3] and x[2] == y[2]]
            held = None if seq[-1][3] else seq[-1]
            if not pairs:
                continue
            new = [edited(x[1], y[1]) for x, y in pairs]
            e = digest_arrays(pa.array(new, pa.large_string()))
            x, y = np.array([p[0][4] for p in pairs]), np.array([p[1][4] for p in pairs])
            cols = [[p[0][0] for p in pairs], [len(p[0][1]) for p in pairs], [hashlib.sha256(t.encode()).hexdigest() for t in new], to_strings(x), to_strings(e), likeness(x, e), likeness(x, y)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds.types, strict=True)], schema=kinds)

    return in_order(docs).mapInArrow(run, _NEXT)


def edited(text: str, next_text: str) -> str:
    """The last half of the characters (rounded down) replaced by the first as many, or all, of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + next_text[:half]
