"""From raw documents to token ids in five stages, each a Parquet table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nearfield.llm import decontaminate, language, line_dedup, ngram_join, storage, word_bpe


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    return language.confident(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier document or line has; what keeps less than a fifth of its characters
    goes, as a near copy: at least 0.8 of it is in earlier documents."""
    return line_dedup.deduplicated(docs, least=0.2)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, similarity 0.8."""
    return ngram_join.one_of_each(docs, n=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, and the text that the ids decode to."""
    return word_bpe.encoded_and_decoded(docs, word_bpe.vocabulary(word_bpe.VOCABULARY))


STAGES = [("language_id", language_id), ("line_dedup", lines), ("ngram_jaccard_join", near_duplicates), ("decontamination", decontamination), ("word_bpe", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = storage.written(stage(spark, docs, sf_dir), name)
    return docs
