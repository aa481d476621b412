"""Every name that an operator uses on the way or adds, as an extra column of the input."""

import pytest
from pyspark.sql import functions as F

from crossloom.llm import bin_slack, decontaminate, fingerprint, heap_codes, line_dedup, max_ent, near_dedup, period_runs, piece_bpe, quality, toxicity, url_filter, warc

NAMES = (
    "_id", "_gone", "gone", "key", "salt", "lost", "tails", "Expected_Grade", "_hit", "_th", "th", "hit", "key_id", "key_th", "score", "PREDICTED", "fingerprint", "likeness", "ids", "n_hit", "items",
    "w", "_w", "g", "h", "rep", "component", "component_id", "kept", "d1", "n", "size", "row", "block", "word", "order", "feature", "other", "grade", "toxic", "k1", "k2", "keeper", "n_docs", "order_", "hit_", "held",
)


@pytest.fixture(scope="module")
def many(docs):
    taken = {c.lower() for c in docs.columns}
    return docs.withColumns({c: F.lit(f"own {c}") for c in NAMES if c.lower() not in taken})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, (k // 2) % 2) for k in range(60)], "doc_id long, quality int, toxic int")


def own(df, replaced=()):
    """Extra columns are what they were."""
    gone = {x.lower() for x in replaced}
    left = [c for c in NAMES if c in df.columns and c.lower() not in gone and c != "rep" and c != "n"]
    assert len(left) > 35
    assert df.where(" OR ".join(f"`{c}` IS DISTINCT FROM 'own {c}'" for c in left)).count() == 0


def test_filters_keep_all_columns(spark, many, labels):
    b = spark.createDataFrame([(1, "w1 w2 w3")], "item_id long, text string")
    model = quality.fit(many, quality.graded(labels))
    for out in (quality.select(many, model), quality.select_labelled(many, labels), line_dedup.remove(many), near_dedup.deduplicate(many), decontaminate.remove(many, b), decontaminate.remove_spans(many, b)):
        assert out.columns == many.columns
        own(out)


def test_added_columns_replace_those_of_their_name(spark, many, labels):
    from crossloom.llm.queries import piece_model

    out = quality.score(many, quality.fit(many, quality.graded(labels)))
    assert out.where("expected_grade < 0 OR size(tails) <> 2").count() == 0 and len(out.columns) == len(many.columns)
    own(out, ["expected_grade", "tails"])
    out = toxicity.score(many, toxicity.fit(many, labels))
    assert out.where("score < 0 OR score > 1 OR predicted NOT IN (0, 1)").count() == 0
    own(out, ["score", "predicted"])
    out = fingerprint.compare(fingerprint.fingerprint(many), "fingerprint", "fingerprint")
    assert out.where("likeness <> 1").count() == 0
    own(out, ["fingerprint", "likeness"])
    out = piece_bpe.encode(many, piece_model())
    assert out.where("ids IS NULL").count() == 0
    own(out, ["ids"])


def test_own_columns_only(spark, many, tmp_path):
    b = spark.createDataFrame([(1, "w1 w2 w3")], "item_id long, text string")
    assert near_dedup.components(many).columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert decontaminate.contamination(many, b).count() == line_dedup.report(many).count() == max_ent.score(many).count() == fingerprint.edited_fingerprints(many).count() == many.count()
    extra = {c: F.lit(1) for c in ("host", "path", "key", "_block", "_maybe", "_in", "w0", "listed", "rule", "verdict", "payload", "payload_digest", "original", "n", "target_uri", "record_type")}
    pages = spark.createDataFrame([(1, "http://a.org/x", "ab"), (2, "http://a.org/y", "ab"), (3, None, None)], "page_id long, url string, html string").withColumns(extra)
    assert {r.page_id: r.verdict for r in url_filter.url_filter(pages, pages.where("page_id = 2").select("url")).collect()} == {1: "allow", 2: "block", 3: "allow"}
    where = str(tmp_path / "w")
    warc.write_archives(warc.resolve_revisits(pages, url_col="url"), where, date="2030-01-01T00:00:00Z")
    got = {r.page_id: (r.record_type, r.refers_to, r.target_uri, r.payload_bytes, r.payload) for r in warc.read_resolved(spark, where).collect()}
    assert got == {1: ("revisit", 2, "http://a.org/x", 2, "ab"), 2: ("response", None, "http://a.org/y", 2, "ab"), 3: ("response", None, None, 0, "")}


def test_new_operators_read_their_own_columns(spark, many):
    from crossloom.llm.queries import word_tokenizer

    packed = bin_slack.pack(many, word_tokenizer())
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and packed.select("doc_id").distinct().count() == many.count()
    assert period_runs.report(many).count() == many.count()
    out = period_runs.collapse(many)
    assert out.columns == many.columns
    own(out)
    runs = period_runs.find(many.withColumns({"start": F.lit("own"), "Unit": F.lit("own")}))
    assert runs.columns[-4:] == ["start", "length", "period", "unit"] and "text" not in runs.columns
    rows = [(k, [float(k % 7 + j % 3) for j in range(16)], k % 2) for k in range(80)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    plain = {r.vec_id: tuple(r) for r in heap_codes.compress(vectors).collect()}
    extra = vectors.withColumns({c: F.lit(f"own {c}") for c in ("ids", "labels", "id", "v", "code", "error", "_label", "label_error", "n", "item", "parts", "k", "s")})
    assert {r.vec_id: tuple(r) for r in heap_codes.compress(extra).collect()} == plain
