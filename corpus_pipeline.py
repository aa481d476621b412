"""A corpus pipeline: quality, line dedup, near-duplicates, decontamination, token ids.

Each stage takes what its predecessor kept, and its rows are written as Parquet and read again.

In all stages: columns that a stage doesn't change are carried along, whatever their names; a null in lang, source or n_chars changes nothing;
texts of any length are read whole; an empty table gives an empty one; an empty table of labels or benchmark items lets
everything stay. Null texts are empty ones but stay null where a stage keeps them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from crossloom.llm import decontaminate, line_dedup, near_dedup, piece_bpe, quality
from crossloom.llm.queries import piece_model, table
from crossloom.runtime import materialise, prepare


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labels, gives a grade of at least 1 with probability 0.5.

    A null or empty text is judged by the thresholds alone; rows with the same text are judged alike, also without doc_id; a
    probability of exactly 0.5 stays."""
    prepare(spark)
    return quality.select_labelled(docs, table(spark, sf_dir, "labels"))


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the long lines that three documents or more share, but for one copy, in the largest doc_id.

    A null or empty text is one empty line and stays; rows that repeat a doc_id are one document; a row without doc_id counts for nothing
    and keeps its lines. ``n_chars`` follows the text."""
    prepare(spark)
    return line_dedup.remove(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with similarity 0.8 or more on five-word shingles, that with the smallest doc_id.

    Texts without words are like nothing and stay; rows that repeat a doc_id share its fate; rows without doc_id stay."""
    prepare(spark)
    return near_dedup.deduplicate(docs, size=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages in a twentieth of their words or more: exactly a twentieth goes.

    Texts without words stay; rows are judged by their own texts, also where doc_ids repeat or are null."""
    prepare(spark)
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, ids: the token ids of each whole text; none for a null or empty one. Each row is encoded on its own."""
    prepare(spark)
    return piece_bpe.encode(docs.select("doc_id", "lang", "source", "n_chars", "text"), piece_model()).drop("text")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("line_dedup", drop_common_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("sentencepiece", to_tokens),
]

#: The classifier isn't SQL; tests/llm/test_pipeline.py compares a run with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
