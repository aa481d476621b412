"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossloom.runtime import materialise, prepare, scratch

PIECE_MODEL = "piece_bpe_32k.model"
WORD_TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(PIECE_MODEL)


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(WORD_TOKENIZER)


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crossloom.llm import fingerprint

    return fingerprint.edited_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, expected_grade, p_good (P(grade >= 1)), p_best (P(grade >= 2)), selected."""
    from crossloom.llm import quality

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, quality.graded(labels))
    scored, tail = quality.score(docs.select("doc_id", "text"), model), lambda k: quality.tail(model, k)
    return scored.select("doc_id", "expected_grade", tail(1).alias("p_good"), tail(2).alias("p_best"), (tail(1) >= 0.5).alias("selected"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list: canonical URLs that two pages or more have (crawled again and again)."""
    from crossloom.llm import url_filter as u

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    listed = pages.where(F.col("url").contains("://")).groupBy(u.canonical(F.col("url")).alias("k")).agg(F.min("url").alias("url"), F.count(F.lit(1)).alias("n")).where("n > 1").select("url")
    return u.url_filter(pages, listed)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crossloom.llm import near_dedup

    return near_dedup.components(table(spark, sf_dir, "documents"), size=4, percent=80)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crossloom.llm import decontaminate

    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are put into an index; a part of them (by a hash) is taken out and put in again, as a crawl does it, before lines
    are dropped from all documents by the index's counts and filters."""
    from crossloom.llm import line_dedup

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    again = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(50)) == 0)
    index = line_dedup.LineIndex(spark)
    index.insert(docs)
    index.delete(again)
    index.insert(again)
    return line_dedup.report(docs, index=index)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crossloom.llm import warc

    where = scratch(spark, "warc")
    warc.write_archives(warc.resolve_revisits(table(spark, sf_dir, "pages"), url_col="url"), where)
    return warc.read_archives(spark, where, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crossloom.llm import toxicity

    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, among=~toxicity.held_out(F.col("doc_id")))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crossloom.llm import piece_bpe

    return piece_bpe.digests(table(spark, sf_dir, "documents"), piece_model())


def op10_max_ent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crossloom.llm import max_ent

    return max_ent.score(table(spark, sf_dir, "documents"))


def op11_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crossloom.llm import bin_slack

    return bin_slack.pack(table(spark, sf_dir, "documents"), word_tokenizer())


def op12_period_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crossloom.llm import period_runs

    return period_runs.report(table(spark, sf_dir, "documents"))


def op13_heap_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crossloom.llm import heap_codes

    return heap_codes.compress(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


_CANONICAL = r"""
SELECT page_id, url,
  translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path,
  array_to_string(list_sort(string_split(regexp_extract(url, '(?s)^.*?://[^?#]*\?([^#]*)', 1), '&')), '&') AS query
FROM pages
"""

_ORACLES = {
    "op3_url_filter": f"""
WITH p AS ({_CANONICAL}),
c AS (SELECT *, CASE WHEN contains(url, '://') THEN host || regexp_replace(path, '/+$', '') || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS k FROM p),
n AS (SELECT *, count(*) OVER (PARTITION BY k) > 1 AND k IS NOT NULL AS listed FROM c),
rules(verdict, rule, h, p) AS (VALUES ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'), ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')),
fit AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM n JOIN rules r ON (n.host = r.h OR ends_with(n.host, '.' || r.h)) AND starts_with(n.path, r.p) GROUP BY page_id)
SELECT n.page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, fit.rule, coalesce(fit.verdict, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed
FROM n LEFT JOIN fit USING (page_id)
""",
    "op4_near_dedup": r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
k AS MATERIALIZED (SELECT doc_id, count(*) AS n, min(doc_id) OVER (PARTITION BY md5(string_agg(t, chr(10) ORDER BY t))) AS rep FROM s GROUP BY doc_id),
r AS MATERIALIZED (SELECT s.doc_id, t, n FROM s JOIN k ON k.doc_id = s.doc_id AND k.rep = k.doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) + any_value(b.n) AS n, count(*) AS m FROM r a JOIN r b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM p WHERE 100 * m >= 80 * (n - m)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT rep AS x, rep AS y FROM k WHERE rep = doc_id UNION SELECT reach.x, ways.b FROM reach JOIN ways ON ways.a = reach.y),
c AS (SELECT x, min(y) AS c FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(k.n, 0) AS n_shingles, coalesce(c.c, d.doc_id) AS component_id, d.doc_id = coalesce(c.c, d.doc_id) AS kept FROM d LEFT JOIN k USING (doc_id) LEFT JOIN c ON c.x = k.rep
""",
    "op5_decontaminate": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS t FROM (SELECT item_id, w, least(len(w), 13) AS m, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM win),
dw AS (SELECT doc_id, m, i, array_to_string(list_slice(w, i, i + m - 1), ' ') AS t FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, sizes WHERE len(w) >= m)),
hit AS (SELECT doc_id, i, win.m, item_id FROM dw JOIN win USING (t, m)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM hit GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
""",
    "op6_line_dedup": r"""
WITH l AS (SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents)),
c AS (SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
f AS (SELECT doc_id, i, line, keeper IS NOT NULL AND keeper <> doc_id AS gone FROM l LEFT JOIN c USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM f GROUP BY doc_id
""",
    "op7_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS s FROM pages),
d AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(8), lambda i: translate(lpad(to_base(CAST('0x' || substr(s, CAST(1 + 5 * i AS INT), 5) AS BIGINT), 32), 4, '0'), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')), '') AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS o FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = o THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> o THEN o END AS refers_to FROM m
""",
}


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
