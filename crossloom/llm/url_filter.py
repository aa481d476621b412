"""URL filter: host and path rules, then a blocked Bloom filter whose hits an exact join confirms.

Only DataFrame functions: no Python runs on executors. A listed URL is compared in canonical form (see ``canonical``).

* The Bloom filter is a table of blocks: a URL's 64-bit hash picks one block, and eight bits in that block's four
  64-bit lanes. The table has about 48 bytes a block and ``KEYS_PER_BLOCK`` listed URLs go to one, so its size follows
  from the count of the list; it is broadcast only up to ``BROADCAST_BLOCKS`` blocks and joined by block beyond.
* URLs that miss the filter are surely not listed and never move. Possible hits go to a hash join with the list, which
  removes false positives. The list is distinct, so the join adds no rows; a URL on many rows is split by AQE.

Cases: a null URL or one without ``://`` has empty host and path, fits no rule and is not listed. Nulls and repeats in
the list count once or not at all. Repeated rows are judged alike. An empty list allows everything that no rule blocks.
Columns of the input beyond the two named are not read, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossloom.runtime import materialise

KEYS_PER_BLOCK = 12
LANES = 4
BITS_PER_LANE = 2
BROADCAST_BLOCKS = 500_000

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_QUERY = r"(?s)^.*?://[^?#]*\?([^#]*)"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def canonical(url: Column) -> Column:
    """Lower-case host, path without closing slashes, query parameters in order; no scheme, no fragment."""
    query = F.array_join(F.array_sort(F.split(F.coalesce(F.regexp_extract(url, _QUERY, 1), F.lit("")), "&")), "&")
    return F.concat(host(url), F.regexp_replace(path(url), "/+$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def rule_columns(host_: Column, path_: Column, rules) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        h, slash, p = text.partition("/")
        fits = ((host_ == h) | host_.endswith("." + h)) & path_.startswith(slash + p)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _block(h: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(h, F.lit(1)), F.lit(blocks))


def _masks(h: Column) -> list[Column]:
    """For each lane the word with a URL's bits; six bits of a second hash name each of them."""
    g = F.xxhash64(h, F.lit(2))
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(g, 6 * k).bitwiseAND(63).cast("int"))
    return [bit(2 * k).bitwiseOR(bit(2 * k + 1)) for k in range(LANES)]


def bloom_blocks(listed: DataFrame, key: str, blocks: int) -> DataFrame:
    """block, w0..w3: the filter, one row for each block that has any bit. Partial aggregation keeps the shuffle small."""
    h = F.xxhash64(F.col(key))
    return listed.select(_block(h, blocks).alias("block"), *(m.alias(f"w{k}") for k, m in enumerate(_masks(h)))).groupBy("block").agg(*(F.bit_or(f"w{k}").alias(f"w{k}") for k in range(LANES)))


def listed_hits(urls: DataFrame, listed: DataFrame, key: str = "key") -> DataFrame:
    """``urls`` with a boolean ``listed``: does its ``key`` occur in ``listed.key``? Rows with a null key are false."""
    blocks = max(1, math.ceil(listed.count() / KEYS_PER_BLOCK))
    table = bloom_blocks(listed, key, blocks)
    if blocks <= BROADCAST_BLOCKS:
        table = F.broadcast(table)
    h = F.xxhash64(F.col(key))
    masks = _masks(h)
    probed = urls.withColumn("_block", F.when(F.col(key).isNotNull(), _block(h, blocks))).join(table.withColumnRenamed("block", "_block"), "_block", "left")
    maybe = F.coalesce(F.col("w0").bitwiseAND(masks[0]) == masks[0], F.lit(False))
    for k in range(1, LANES):
        maybe = maybe & F.coalesce(F.col(f"w{k}").bitwiseAND(masks[k]) == masks[k], F.lit(False))
    probed = probed.withColumn("_maybe", maybe).drop("_block", *(f"w{k}" for k in range(LANES)))
    sure = probed.where(~F.col("_maybe")).drop("_maybe").withColumn("listed", F.lit(False))
    exact = probed.where("_maybe").drop("_maybe").join(listed.select(key).withColumn("_in", F.lit(True)), key, "left")
    return sure.unionByName(exact.withColumn("listed", F.coalesce("_in", F.lit(False))).drop("_in"))


def url_filter(pages: DataFrame, listed: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Judge every row: ``id_col``, host, path, rule, verdict, listed.

    ``listed`` has one column ``url``; its canonical forms are blocked unless a rule fits. ``rules`` are a few
    (verdict, ``host/path``) pairs."""
    listed = materialise(listed.where(F.col("url").contains("://")).select(canonical(F.col("url")).alias("key")).distinct(), "listed")
    url = F.col(url_col)
    rows = pages.select(F.col(id_col), host(url).alias("host"), path(url).alias("path"), F.when(url.contains("://"), canonical(url)).alias("key"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    return listed_hits(rows, listed).select(
        id_col, "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "listed",
    )
