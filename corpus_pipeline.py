"""Cleaning a corpus in stages; each stage is written as Parquet and read again as the input of the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import bpe, exact, language, latent, ngram_join, queries
from ledgerlens.llm.common import table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled rows teach; texts without letters go. The model learns from the same folds as op8."""
    model = language.fit_languages(docs, language.fold(F.col("doc_id")) != 0)
    found = language.identify_languages(docs, model)
    return found.where(F.col("lang_pred") != language.UNKNOWN).select(docs.columns)


def with_own_ids(docs: DataFrame) -> DataFrame:
    """Add ``own_id``, different for every row: the doc_id where it names one row, else a number of the row above all usual ids.

    The stages decide by it, so that a row without doc_id, or one of several with the same, is judged by its own text.
    """
    repeated = written(docs.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("shared_id")), "pipeline-shared-ids")
    if repeated.isEmpty():
        return docs.withColumn("own_id", F.col("doc_id").cast("long"))
    numbered = docs.withColumn("row_id", F.monotonically_increasing_id() + F.lit(1 << 62))
    marked = numbered.join(repeated.withColumn("shared", F.lit(True)), F.col("doc_id").eqNullSafe(F.col("shared_id")), "left")
    # written, so that every use sees the same numbers
    return written(marked.withColumn("own_id", F.when(F.col("shared"), F.col("row_id")).otherwise(F.col("doc_id").cast("long"))).select(*docs.columns, "own_id"), "pipeline-own-ids")


def by_own_id(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("own_id").alias("doc_id"), "text")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts (white space apart), rows without doc_id and repeated rows included."""
    rows = with_own_ids(docs)
    kept = exact.exact_duplicates(by_own_id(rows)).where("kept").select(F.col("doc_id").alias("own_id"))
    return rows.join(kept, "own_id", "left_semi").select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, the one with the least doc_id, of each group linked by five-word shingles at a similarity of 0.8."""
    rows = with_own_ids(docs)
    found = ngram_join.ngram_components(by_own_id(rows), size=5, percent=80)
    gone = found.where("component_id <> doc_id").select(F.col("doc_id").alias("own_id"))
    return rows.join(gone, "own_id", "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a benchmark item."""
    rows = with_own_ids(docs)
    leaks = latent.find_leaks(by_own_id(rows), table(spark, sf_dir, "benchmark"), latent.fit_space(by_own_id(rows)))
    return rows.join(leaks.select(F.col("doc_id").alias("own_id")).distinct(), "own_id", "left_anti").select(docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents that are left."""
    words = queries.vocabulary("word_bpe_49k.json")
    return bpe.bpe_encode(docs.select("doc_id", "text", "lang", "source"), words).select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language id", language_id),
    ("exact dedup", exact_dedup),
    ("n-gram jaccard join", near_dedup),
    ("benchmark decontamination", decontamination),
    ("bpe", tokenize),
]
#: Languages, trie groups, retrieval and tokens have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
