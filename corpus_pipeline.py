"""A corpus pipeline of five operators; each stage's result is written and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from navengine.llm import language_id, quality
from navengine.llm.common import clear, mark, materialize, table
from navengine.llm.folds import held_out
from navengine.llm.jaccard_join import ngram_jaccard_join
from navengine.llm.line_dedup import dedup_lines
from navengine.llm.packing import pack


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows with a score of at least a half; und goes, and so do null and empty texts. Rows with a null id or a repeated one are judged by their own text."""
    model = language_id.train(docs.where(~held_out()))
    return language_id.identify(docs, model).where("lang_pred <> 'und' and score >= 0.5").select(*docs.columns)


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.7; each row is judged by its own text, a null one like an empty one. A label counts for every row with its id, a null id has none."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = quality.train(docs.select("doc_id", "text").where(~held_out()).join(labels, "doc_id"))
    return quality.classify(docs, model).where("predicted = 1").select(*docs.columns)


def stage_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without recurring lines; n_chars follows the text. Rows with the same id, and those with none, count as one document; null and empty texts stay as they are."""
    return dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str, broadcast_rows: int = 1_000_000) -> DataFrame:
    """One row of each group of near copies: the one with the smallest id, and of rows with that id the first by hash of the text.

    Rows are removed, not ids: what has an id in common with a copy but another text stays. Null and empty texts are copies of nothing and all stay; a
    null id comes after all others.
    """
    rows = _numbered(docs)
    linked = materialize(ngram_jaccard_join(rows, "__nav_row", "text").where("n_shingles > 0"), "linked")
    gone = _known(linked.where("doc_id <> component_id"), "gone", broadcast_rows)
    repeated = _known(linked.groupBy("doc_id").count().where("count > 1"), "repeated", broadcast_rows)
    kept = rows.join(gone, "__nav_row", "left_anti")
    if not repeated.isEmpty():
        once = kept.join(repeated, "__nav_row", "left_semi").dropDuplicates(["__nav_row"])
        kept = kept.join(repeated, "__nav_row", "left_anti").unionByName(once)
    return kept.select(*docs.columns)


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with __nav_row: the id (null last) and the text's hash."""
    text = F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull())
    return docs.withColumn("__nav_row", F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), text.alias("text")))


def _known(linked: DataFrame, name: str, broadcast_rows: int) -> DataFrame:
    """Distinct (__nav_row) of these rows, to be broadcast if they are few."""
    found = materialize(linked.select(F.col("doc_id").alias("__nav_row")).distinct(), name)
    return F.broadcast(found) if found.count() <= broadcast_rows else found  # some thirty bytes a row


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens; a null or empty text is one end token, and repeated rows are packed each."""
    return pack(docs)


STAGES = [
    ("language_id", stage_language),
    ("quality_classifier", stage_quality),
    ("line_dedup", stage_lines),
    ("ngram_jaccard_join", stage_near_duplicates),
    ("best_fit_packing", stage_packing),
]

#: Trained classifiers, the similarity join and packing have no SQL; tests/llm/test_pipeline.py holds the join stage against brute force and the others against invariants.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage wrote for itself and for the next one is deleted as soon as that one's result is written."""
    docs = table(spark, sf_dir, "documents")
    start = mark()
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, name)
            clear(start, keep=docs)
    return docs
