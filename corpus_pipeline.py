"""A training corpus from ``documents``: quality, line dedup, near-duplicate dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; ``run`` writes each stage's rows as
Parquet under the shared checkpoint folder and rereads them. All stages but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekit.llm import line_dedup, ngram_join, quality_classifier, sentencepiece_viterbi, source_mix
from lorekit.session import stage_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier accepts; it learns from the labelled documents of the learning folds."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_classifier.keep_good(docs, quality_classifier.train(docs, labels))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their cross-site boilerplate lines; one that has nothing else goes, as each line has its home."""
    rows = line_dedup.line_dedup(docs, keep_emptied=False)
    return rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else rows


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8), the one with the smallest id; rows without id stay."""
    return ngram_join.keep_first(docs, percent=80, shingle=5)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source weights; a document taken twice is there twice."""
    return source_mix.mix_sources(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, token_ids, round_trip) of the mix."""
    return sentencepiece_viterbi.encode(docs)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates),
          ("mixing sources to target weights", mix), ("SentencePiece encoding and decoding", tokens)]

#: Learned scores and Viterbi segments have no SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = stage_path(spark, "pipeline")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
