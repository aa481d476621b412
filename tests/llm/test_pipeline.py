import re

import pytest

import corpus_pipeline
from crossloom.llm import decontaminate, line_dedup, near_dedup, quality

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    rows = docs.drop("n", "rep")
    junk = spark.createDataFrame([(5000 + k, "buy $$$ $$$ !!! now", "en", "s", 19) for k in range(30)], rows.schema)
    rows.unionByName(junk).write.parquet(f"{d}/documents.parquet")
    labels = [(k, 1, 0) for k in range(0, 150, 2)] + [(5000 + k, 0, 0) for k in range(30)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    t = [r.text for r in docs.where("doc_id IN (1, 4)").collect()]
    spark.createDataFrame(list(enumerate(t)), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_stages_equal_brute_force(spark, folder):
    import sentencepiece
    import public_tokenizers

    from .tests_helpers import brute_contaminated, brute_line_texts, brute_near

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality.fit(docs, quality.graded(spark.read.parquet(f"{folder}/labels.parquet")))
    kept = {r.doc_id: r.text for r in quality.select(docs, model).collect()}
    assert not any(i >= 5000 for i in kept) and len(kept) > 100
    kept = brute_line_texts(kept)
    kept = brute_near(kept, 5)
    kept = brute_contaminated(kept, [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()])
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, folder).collect()}
    assert got == {i: sp.encode(t or "") for i, t in kept.items()}


def test_stages_keep_columns_and_take_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
    none = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0


def test_stages_on_odd_rows(spark, odd_docs, folder):
    """Rows without id, repeated ids, null texts and clashing columns go through every stage; the written result is read by the next one."""
    docs = odd_docs.drop("n", "rep").selectExpr("*", "'own' AS score", "'own' AS `_gone`", "'own' AS kept", "'own' AS w")
    left = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        docs = corpus_pipeline.materialise(out, f"odd-{name}")
        assert 0 < docs.count() <= left and docs.where("score <> 'own' OR `_gone` <> 'own' OR kept <> 'own' OR w <> 'own'").count() == 0
        left = docs.count()
    assert docs.where("doc_id IS NULL").count() == 2
    out = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "ids"] and out.count() == left and out.where("ids IS NULL").count() == 0


def test_labels_of_low_quality_only(spark, docs, tmp_path):
    rows = docs.drop("n", "rep")
    spark.createDataFrame([(k, 0, 0) for k in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.keep_good(spark, rows, str(tmp_path)).count() == 0


def test_methods_are_the_named_ones():
    names = [re.sub(r"\W", "", n) for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "line_dedup", "near_dedup", "decontamination", "sentencepiece"]
    assert all((decontaminate, line_dedup, near_dedup))
