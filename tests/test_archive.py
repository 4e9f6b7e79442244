"""Rotation of the observation table: bounded files, equal rows at any time, late rows, a run that broke off."""

import glob
import os

from pyspark.sql import functions as F

from lorekit.streaming import archive, twins


def add(spark, path, first, n, day):
    """A micro-batch of the sink: n small files of a day."""
    rows = spark.range(first, first + n).select((F.lit(f"{day} 10:00:00").cast("timestamp") + F.make_interval(secs=F.col("id") % 50)).alias("ts"),
                                                F.col("id").alias("seq"), F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("session_id"))
    rows.withColumn("date", F.to_date("ts")).repartition(6).write.mode("append").partitionBy("date").parquet(path)


def seqs(spark, path, root):
    return sorted(r.seq for r in archive.read_observations(spark, path, root).collect())


def test_rows_stay_and_files_get_fewer(spark, tmp_dir):
    path, root = os.path.join(tmp_dir, "obs"), os.path.join(tmp_dir, "archive")
    add(spark, path, 0, 300, "2024-01-01")
    add(spark, path, 300, 100, "2024-01-02")
    assert seqs(spark, path, root) == list(range(400))
    reader = archive.read_observations(spark, path, root)
    assert archive.archive_observations(spark, path, root, "2024-01-02", rows_per_file=100) == 0
    assert archive.archive_observations(spark, path, root, "2024-01-02", rows_per_file=100) is None
    assert reader.count() == 400 and seqs(spark, path, root) == list(range(400))
    files = glob.glob(os.path.join(root, "data", "run=*", "date=2024-01-01", "*.parquet"))
    assert 3 <= len(files) <= 6 and all(spark.read.parquet(f).count() <= 100 for f in files)
    add(spark, path, 400, 20, "2024-01-01")                      # late rows of a day that was taken
    assert seqs(spark, path, root) == list(range(420))
    assert archive.archive_observations(spark, path, root, "2024-01-03", rows_per_file=100) == 1
    assert seqs(spark, path, root) == list(range(420)) and archive.live_rows(spark, path, root).count() == 0


def test_a_run_that_broke_off_is_not_seen(spark, tmp_dir):
    path, root = os.path.join(tmp_dir, "obs"), os.path.join(tmp_dir, "archive")
    add(spark, path, 0, 50, "2024-01-01")
    archive.archive_observations(spark, path, root, "2024-01-02")
    os.unlink(os.path.join(root, "files", "run=00000000", "_SUCCESS"))
    assert seqs(spark, path, root) == list(range(50))
    assert archive.archive_observations(spark, path, root, "2024-01-02") == 0
    assert seqs(spark, path, root) == list(range(50))


def test_the_sink_of_a_stream(spark, tmp_dir):
    schema = "ts timestamp, seq long, session_id string, date date"
    rows = spark.range(200).select(F.lit("2024-01-01 10:00:00").cast("timestamp").alias("ts"), F.col("id").alias("seq"), F.lit("s").alias("session_id"))
    rows.withColumn("date", F.to_date("ts")).coalesce(1).write.parquet(os.path.join(tmp_dir, "in"))
    path, root = os.path.join(tmp_dir, "obs"), os.path.join(tmp_dir, "archive")
    s = spark.readStream.schema(schema).parquet(os.path.join(tmp_dir, "in"))
    twins.sink_observations(s, path, os.path.join(tmp_dir, "ck"), rows_per_file=30).awaitTermination()
    files = glob.glob(os.path.join(path, "date=2024-01-01", "*.parquet"))
    assert len(files) == 7 and all(spark.read.parquet(f).count() <= 30 for f in files)
    assert archive.archive_observations(spark, path, root, "2024-01-02", rows_per_file=1000) == 0
    assert seqs(spark, path, root) == list(range(200))
    assert len(glob.glob(os.path.join(root, "data", "run=*", "date=2024-01-01", "*.parquet"))) == 1
