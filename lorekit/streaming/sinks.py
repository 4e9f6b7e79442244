"""``foreachBatch`` bodies that upsert the knowledge base's keyed tables through ``KeyedLog``.

Each batch is one write of its log, made from the state before it, so a replayed batch writes the same rows again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekit.operators.digest import file_back_qa
from lorekit.operators.instincts import instinct_key, merge_evidence, upsert_instincts
from lorekit.operators.scope import register_projects
from lorekit.sources.keyed_log import KeyedLog
from lorekit.streaming.twins import REGISTRY_ROWS

INSTINCT_ROWS = ("key string, trigger string, action string, domain string, confidence decimal(6,2), source string, evidence_count bigint, "
                 "created date, last_seen date, updated date, projects array<string>")
EVIDENCE_ROWS = "key string, line string, ts timestamp"
ARTICLE_ROWS = "slug string, content string"


def registry_log(spark: SparkSession, root: str) -> KeyedLog:
    return KeyedLog(spark, f"{root}/registry", REGISTRY_ROWS, ["id"])


def instinct_logs(spark: SparkSession, root: str) -> tuple[KeyedLog, KeyedLog]:
    """The instincts and their evidence lines."""
    return KeyedLog(spark, f"{root}/instincts", INSTINCT_ROWS, ["key"]), KeyedLog(spark, f"{root}/evidence", EVIDENCE_ROWS, ["key", "line"])


def article_log(spark: SparkSession, root: str) -> KeyedLog:
    return KeyedLog(spark, f"{root}/articles", ARTICLE_ROWS, ["slug"])


def upsert_registry(root: str, as_of_date: str):
    """Batches of detected projects (``stamp_project`` rows): new ids get an entry, existing ones are never changed."""
    def fn(batch: DataFrame, epoch: int) -> None:
        log = registry_log(batch.sparkSession, root)
        old = log.read(below=epoch)
        log.write(register_projects(old, batch, as_of_date).join(old.select("id"), "id", "left_anti"), epoch)
    return fn


def upsert_instinct_tables(root: str):
    """Batches of proposals (id, trigger, action, domain, confidence, evidence, ts): the touched instincts are folded on,
    and evidence lines are kept once each, as of their first time."""
    def fn(batch: DataFrame, epoch: int) -> None:
        instincts, evidence = instinct_logs(batch.sparkSession, root)
        keys = batch.select(instinct_key(F.col("id"), F.col("trigger")).alias("key"))
        folded, lines = upsert_instincts(instincts.rows_of(keys, below=epoch), batch)
        evidence.upsert(lines, epoch, lambda old, new: merge_evidence(old, new.select("key", "line", F.col("ts").cast("timestamp").alias("ts"))))
        instincts.write(folded, epoch)
    return fn


def file_back_articles(root: str):
    """Batches of answered questions (question, answer, ts): the last one of a slug is its article; each adds an entry
    to the build log, whose parts are the batches."""
    def fn(batch: DataFrame, epoch: int) -> None:
        articles, entries = file_back_qa(batch)
        article_log(batch.sparkSession, root).write(articles, epoch)
        entries.write.mode("overwrite").parquet(f"{root}/build_log/epoch={epoch}")
    return fn
