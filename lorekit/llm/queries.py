"""Queries of the training-data operators: (spark, sf_dir) -> DataFrame over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekit.llm import (conversation_trie, hard_negatives, language_id, line_dedup, ngram_join, quality_classifier, quality_rules, sentencepiece_viterbi, source_mix,
                         token_counts)
from lorekit.llm.embedding_dedup import embedding_links
from lorekit.llm.substring_dedup import substring_dedup
from lorekit.llm.suffix_dedup import suffix_dedup


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.quality_rules(docs, quality_rules.train_field(docs, table(spark, sf_dir, "labels")))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.document_token_counts(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.quality_scores(docs, quality_classifier.train(docs, table(spark, sf_dir, "labels")))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix_report(table(spark, sf_dir, "documents"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_components(table(spark, sf_dir, "documents"))


def op9_sentencepiece_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_viterbi.encode(table(spark, sf_dir, "documents"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(table(spark, sf_dir, "embeddings"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 50 == 0)


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.train(docs))


QUERIES = {f.__name__: f for f in (
    op1_substring_dedup, op2_line_dedup, op3_quality_rules, op4_suffix_dedup, op5_token_counts, op6_quality_classifier,
    op7_source_mix, op8_ngram_join, op9_sentencepiece_viterbi, op10_embedding_dedup, op11_hard_negatives,
    op12_conversation_trie, op13_language_id)}

#: DuckDB SQL of the queries that SQL can express; the others are tested against brute force.
ORACLE = {"op2_line_dedup": line_dedup.ORACLE, "op7_source_mix": source_mix.ORACLE,
          "op11_hard_negatives": hard_negatives.ORACLE, "op12_conversation_trie": conversation_trie.ORACLE}
