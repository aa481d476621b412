"""Benchmark decontamination: find benchmark word windows in documents, by DataFrame functions only.

Words are runs of ASCII digits, letters (A-Z lower-cased) and all characters beyond ASCII. A benchmark item's windows are its
runs of ``WINDOW`` consecutive words; a shorter item is one window.

A window of m words covers a whole aligned gram (one that starts at a multiple of s) of s = (m + 1) // 2 words, wherever it
stands. So each document is first reduced to hashes of its aligned grams, a (1/s)-th of its words, and these are looked up in a
broadcast hash set of all grams of benchmark windows; what goes through this join is a document's key and a hash, never its text. Only documents with a
hit are scanned window by window, in pieces of ``PIECE`` windows, and each hit is verified by comparing the words themselves. The
broadcast tables hold ``BROADCAST_GRAMS`` rows at most; a larger benchmark is joined by shuffle.

Cases: a null or empty text has no words and no hits, a null or empty item no windows. Repeated items all count, under their own ids;
null item ids are left out of the list of items, but their windows count as hits. Rows with the same doc_id are judged by their own
texts. Very long texts are split into their words within one row, and into windows piece by piece. Columns beyond those named are carried along
only by ``remove`` and ``remove_spans``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossloom.llm._columns import unused
from crossloom.runtime import materialise

WINDOW = 13
BROADCAST_GRAMS = 2_000_000
PIECE = 1000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def raw_words(text: Column) -> Column:
    """Words in their own case. (Capitals are word characters here, as they are lower-cased in the rule.)"""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _BETWEEN), "")


def words(text: Column) -> Column:
    return raw_words(F.translate(text, _UPPER, _LOWER))


def _gram(words_: Column, at: Column, size: int) -> Column:
    """Hash of some words, blind to case. Full lower-casing equates more than A-Z does, so no hit is missed."""
    return F.xxhash64(F.lower(F.array_join(F.slice(words_, at, size), " ")))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """text, m, items: distinct windows, their count of words, and the ids of the items that have them."""
    w = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0).withColumn("m", F.least(F.size("w"), F.lit(window)))
    starts = F.sequence(F.lit(1), F.size("w") - F.col("m") + 1)
    each = w.select("item_id", "m", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, F.col("m")), " "))).alias("text"))
    return each.groupBy("text", "m").agg(F.collect_set("item_id").alias("items"))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_GRAMS else df


def suspects(docs: DataFrame, windows: DataFrame, sizes: list[int]) -> DataFrame:
    """doc_id, th: distinct keys of documents that hold an aligned gram of a window."""
    out = None
    by_gram = {}
    for m in sizes:
        by_gram.setdefault((m + 1) // 2, []).append(m)
    for s, ms in sorted(by_gram.items()):
        w = F.split("text", " ")
        grams = windows.where(F.col("m").isin(ms)).select(F.explode(F.transform(F.sequence(F.lit(1), F.col("m") - s + 1), lambda i: _gram(w, i, s))).alias("g")).distinct()  # noqa: B023
        d = docs.select("doc_id", F.xxhash64("text").alias("th"), raw_words(F.col("text")).alias("_w")).where(F.size("_w") >= s)
        aligned = F.transform(F.sequence(F.lit(1), F.size("_w") - s + 1, F.lit(s)), lambda i: _gram(F.col("_w"), i, s))  # noqa: B023
        hit = d.select("doc_id", "th", F.explode(aligned).alias("g")).join(_small(grams), "g", "left_semi").select("doc_id", "th")
        out = hit if out is None else out.unionByName(hit)
    return out.distinct()


def _keyed(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """``rows`` joined with ``keys`` by doc_id and the hash of the text. Rows without doc_id are dealt by the hash alone."""
    id_, th = unused(rows, "key_id"), unused(rows, "key_th")
    keys = keys.withColumnsRenamed({"doc_id": id_, "th": th})
    return rows.join(keys, rows["doc_id"].eqNullSafe(keys[id_]) & (F.xxhash64(rows["text"]) == keys[th]), how)


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, th (hash of the text), n_words, n_hit, items, spans: rows of documents with an occurrence of a window.

    spans are (first word, count of words), items the ids of items with an occurring window."""
    windows = materialise(benchmark_windows(benchmark, window), "windows")
    sizes = sorted(r["m"] for r in windows.select("m").distinct().collect())
    if not sizes:
        return docs.select("doc_id", F.xxhash64("text").alias("th"), F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<bigint>").alias("items"), F.array().cast("array<struct<at:int,m:int>>").alias("spans")).where("false")
    keys = materialise(suspects(docs, windows, sizes), "suspects")
    found = _keyed(docs.select("doc_id", "text"), _small(keys), "left_semi").select("doc_id", F.xxhash64("text").alias("th"), words(F.col("text")).alias("w"))
    # Pieces of a text overlap by a window less one word, so each of its windows is whole in one of them.
    most = max(sizes)
    firsts = F.sequence(F.lit(0), F.size("w") - 1, F.lit(PIECE))
    cut = F.transform(firsts, lambda i: F.struct(i.alias("first"), F.slice("w", i + 1, PIECE + most - 1).alias("w")))
    pieces = found.where(F.size("w") > 0).select("doc_id", "th", F.size("w").cast("long").alias("n_words"), F.explode(cut).alias("p"))
    pieces = materialise(pieces.select("doc_id", "th", "n_words", "p.first", "p.w"), "pieces")
    small = _small(windows)
    hits = None
    for m in sizes:
        starts = F.sequence(F.lit(1), F.least(F.size("w") - m + 1, F.lit(PIECE)))
        at = pieces.where(F.size("w") >= m).select("doc_id", "th", "n_words", "first", F.posexplode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, m), " "))).alias("at", "text"))  # noqa: B023
        one = at.join(small.where(F.col("m") == m), "text").select("doc_id", "th", "n_words", F.struct((F.col("first") + F.col("at")).alias("at"), "m").alias("span"), "items")
        hits = one if hits is None else hits.unionByName(one)
    spans = hits.groupBy("doc_id", "th", "n_words").agg(F.collect_set("span").alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, x: F.struct(
        F.greatest(acc["end"], x["at"] + x["m"]).alias("end"),
        (acc["n"] + F.greatest(F.lit(0), x["at"] + x["m"] - F.greatest(acc["end"], x["at"]))).cast("long").alias("n"),
    )
    covered = F.aggregate(F.array_sort("spans"), zero, step)["n"]
    return spans.select("doc_id", "th", "n_words", covered.alias("n_hit"), "items", "spans")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row."""
    found = occurrences(docs.select("doc_id", "text"), benchmark, window).drop("spans", "n_words")
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), F.size(raw_words(F.col("text"))).cast("long").alias("n_words"))
    x = rows.join(found.withColumnsRenamed({"doc_id": "key_id", "th": "key_th"}), F.col("doc_id").eqNullSafe(F.col("key_id")) & (F.col("th") == F.col("key_th")), "left")
    items = F.coalesce(F.col("items"), F.array().cast("array<bigint>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return x.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(items.cast("array<string>")), ",").cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def remove(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows of ``docs``, with all of their columns, that aren't contaminated: no hit, or under a twentieth of their words."""
    found = occurrences(docs.select("doc_id", "text"), benchmark, window)
    gone = materialise(found.where(20 * F.col("n_hit") >= F.col("n_words")).select("doc_id", "th"), "contaminated")
    return _keyed(docs, _small(gone), "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """All rows and columns of ``docs``; words inside an occurrence of a window are cut out of ``text``, with what stands between
    two of them. Texts without occurrence stay as they are."""
    found = occurrences(docs.select("doc_id", "text"), benchmark, window)
    hit = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["m"] - 1))))
    mark = unused(docs, "hit")
    cut = materialise(found.select("doc_id", "th", hit.alias(mark)), "spans")
    joined = _keyed(docs, _small(cut), "left")
    words_ = raw_words(F.col("text"))
    between = F.split("text", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    gone = lambda i: F.array_contains(mark, i)
    each = F.transform(
        F.sequence(F.lit(0), F.size(words_) - 1),
        lambda i: F.concat(F.when(gone(i), F.lit("")).otherwise(F.get(words_, i)), F.when(gone(i) & gone(i + 1), F.lit("")).otherwise(F.get(between, i + 1))),
    )
    text = F.when(F.col(mark).isNull(), F.col("text")).otherwise(F.concat(F.get(between, F.lit(0)), F.array_join(each, "")))
    return joined.withColumn("text", text).select(docs.columns)
