"""Rotation of the observation table: past days' small files are gathered into few files of bounded size.

An archive run takes the committed files of the sink that no earlier run has taken, writes their rows under
``data/run=N`` and then their names under ``files/run=N``. A reader takes the rows of finished runs and, of the sink,
the files that are in none, so it sees each row once at any time, also rows that come late for a day already taken."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekit.session import cut_lineage, list_paths

ROWS_PER_FILE = 1_000_000


def runs(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the finished runs."""
    return sorted(int(p.rsplit("/run=", 1)[1].split("/")[0]) for p in list_paths(spark, f"{root.rstrip('/')}/files/run=*/_SUCCESS"))


def taken_files(spark: SparkSession, root: str) -> DataFrame:
    paths = [f"{root.rstrip('/')}/files/run={n:08d}" for n in runs(spark, root)]
    return spark.read.parquet(*paths).select("file") if paths else spark.createDataFrame([], "file string")


def live_rows(spark: SparkSession, path: str, root: str) -> DataFrame:
    """The sink's rows in files that no run has taken, with the name of their ``file``."""
    rows = spark.read.parquet(path).withColumn("file", F.col("_metadata.file_name"))
    return rows.join(taken_files(spark, root), "file", "left_anti")


def archive_observations(spark: SparkSession, path: str, root: str, before: str, rows_per_file: int = ROWS_PER_FILE) -> int | None:
    """Take the sink's new files of days before ``before``; returns the run's number, None if there are none.

    A day's rows are dealt by a hash to as many tasks as files they fill, so no task holds a day. A run that breaks off
    is not seen by readers, and the next one writes over it."""
    root = root.rstrip("/")
    new = live_rows(spark, path, root).where(F.col("date") < F.lit(before).cast("date"))
    files = cut_lineage(new.select("file").distinct())
    if files.isEmpty():
        return None
    number = max(runs(spark, root), default=-1) + 1
    rows = new.drop("file")
    sizes = rows.groupBy("date").agg(F.ceil(F.count(F.lit(1)) / rows_per_file).alias("_files"))
    rows = rows.join(sizes, "date").withColumn("_part", F.pmod(F.xxhash64("session_id", "ts", "seq"), F.col("_files")))
    (rows.repartition("date", "_part").drop("_files", "_part").write.mode("overwrite").option("maxRecordsPerFile", rows_per_file)
     .partitionBy("date").parquet(f"{root}/data/run={number:08d}"))
    files.write.mode("overwrite").parquet(f"{root}/files/run={number:08d}")
    return number


def read_observations(spark: SparkSession, path: str, root: str) -> DataFrame:
    """All observations: those of finished runs and the sink's others."""
    live = live_rows(spark, path, root).drop("file")
    out = live
    for n in runs(spark, root):
        out = out.unionByName(spark.read.schema(live.schema).parquet(f"{root.rstrip('/')}/data/run={n:08d}"))
    return out
