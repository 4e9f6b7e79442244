"""Assemble the vault tables once from the driver tables.

Tables that several jobs share (articles, links, frontmatter, dailies, state,
registry, sections, index rows, instincts) are extracted once per run and kept
as parquet under the session's ``spark.checkpoint.dir`` (the shared folder on a
cluster): lineage is cut, a lost executor costs a re-read instead of a re-parse,
and every later plan starts from a scan with column pruning and pushdown
instead of re-deriving the whole vault."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekit.operators import extract
from lorekit.session import stage_path
from lorekit.sources import adapters as A

MATERIALIZED_KEYS = {"articles", "links", "frontmatter", "dailies", "state", "registry", "sections", "index_rows",
                     "findings"}
_TABLES: dict[tuple, DataFrame] = {}


def materialize(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet under the checkpoint folder and read it back."""
    path = stage_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def input_stamp(spark: SparkSession, sf_dir: str) -> int:
    """A number that changes with the vault's input files: a sum of hashes of their paths, sizes and times, taken
    from the listing alone."""
    paths = [f"{sf_dir.rstrip('/')}/{t}.parquet" for t in ("documents", "events", "conversations")]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    one = F.xxhash64("path", "modificationTime", "length").cast("decimal(38,0)")
    return int(files.agg(F.sum(one)).first()[0] or 0)


def _enabled() -> bool:
    return os.environ.get("LOREKIT_MATERIALIZE", "1") != "0"


class Vault(dict):
    """Lazy dict of the vault tables; each entry is built on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir
        self.stamp = input_stamp(spark, sf_dir)
        self._builders = {
            "documents": lambda: A.load(spark, sf_dir, "documents"),
            "events": lambda: A.load(spark, sf_dir, "events"),
            "conversations": lambda: A.load(spark, sf_dir, "conversations"),
            "files": lambda: A.vault_from_documents(self["documents"]),
            "articles": lambda: extract.build_articles(self["files"]),
            "knowledge_slugs": lambda: self["articles"].select("slug"),
            "links": lambda: extract.extract_links(self["articles"]),
            "frontmatter": lambda: extract.extract_frontmatter(self["articles"]),
            "dailies": lambda: A.dailies_from_events(self["events"]),
            "state": lambda: A.state_from_dailies(self["dailies"]),
            "registry": lambda: A.registry_from_sources(self["documents"]),
            "sections": lambda: extract.extract_sections(self["dailies"], self["registry"]),
            "index_rows": lambda: A.index_from_articles(self["articles"]),
            "sessions": lambda: A.sessions_from_conversations(self["conversations"]),
            "turns": lambda: A.turns_from_conversations(self["conversations"]),
            "observations": lambda: A.observations_from_events(self["events"]),
            "candidates": lambda: A.candidates_from_events(self["events"]),
            "findings": lambda: A.findings_from_documents(self["documents"]),
        }

    def _memo_key(self, key: str) -> tuple:
        return (self.spark.sparkContext.applicationId, self.sf_dir, self.stamp, key)

    def cached(self, key: str, build) -> DataFrame:
        """A shared table: built once per run, written, and read back afterwards."""
        if key in self:
            return self[key]
        mk = self._memo_key(key)
        if _enabled():
            if mk not in _TABLES:
                _TABLES[mk] = materialize(self.spark, build(), key)
            df = _TABLES[mk]
        else:
            df = build()
        self[key] = df
        return df

    def _articles(self) -> DataFrame:
        """The articles; their bodies, the ends of their contents, are written once, within these."""
        df = self.cached("article_files", lambda: self._builders["articles"]().withColumn("n_body", F.length("body")).drop("body"))
        return df.select("slug", "kind", "content", "projects", F.right("content", F.col("n_body")).alias("body"), "n_words")

    def __missing__(self, key: str) -> DataFrame:
        if key == "articles":
            self[key] = self._articles()
            return self[key]
        if key in MATERIALIZED_KEYS:
            return self.cached(key, self._builders[key])
        df = self._builders[key]()
        self[key] = df
        return df
