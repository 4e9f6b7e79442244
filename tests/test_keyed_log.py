"""The change log: merge on read, replay, readers during a compaction, and the sinks that use it."""

import os
import random

import pytest
from pyspark.sql import functions as F

from lorekit.operators.digest import file_back_qa
from lorekit.operators.instincts import merge_evidence, upsert_instincts
from lorekit.operators.scope import stamp_project
from lorekit.plans.vault import Vault
from lorekit.sources.keyed_log import KeyedLog
from lorekit.streaming import sinks
from conftest import SF_SMALL


def log_at(spark, root, buckets=4):
    return KeyedLog(spark, root, "k string, v int", ["k"], buckets)


def write(spark, log, epoch, rows, deleted=False):
    log.write(spark.createDataFrame(rows, "k string, v int"), epoch, deleted)


def content(log, **more):
    return dict(map(tuple, log.read(**more).collect()))


def test_random_writes_compactions_and_replays(spark, tmp_dir):
    rnd, want, log = random.Random(7), {}, log_at(spark, tmp_dir)
    assert content(log) == {} and log.compact() is None
    for epoch in range(8):
        keys = rnd.sample("abcdefgh", 3)
        if epoch in (3, 6):
            write(spark, log, epoch, [(k, None) for k in keys], deleted=True)
            for k in keys:
                want.pop(k, None)
        else:
            rows = [(k, rnd.randrange(100)) for k in keys]
            for _ in range(1 + epoch % 2):                       # replayed
                write(spark, log, epoch, rows)
            before = dict(want)
            want.update(rows)
            assert content(log, below=epoch) == before
        if epoch in (2, 6):
            assert log.compact() == epoch and log.compact() is None
        assert content(log) == want
    assert log.versions() == [2, 6] and log.epochs() == list(range(8))


def test_a_reader_keeps_its_state_through_writes_and_compactions(spark, tmp_dir):
    log = log_at(spark, tmp_dir)
    write(spark, log, 0, [("a", 1), ("b", 1)])
    reader = log.read()
    write(spark, log, 1, [("b", 2), ("c", 2)])
    later = log.read()
    log.compact()
    write(spark, log, 2, [("a", 3)])
    assert dict(map(tuple, reader.collect())) == {"a": 1, "b": 1}
    assert dict(map(tuple, later.collect())) == {"a": 1, "b": 2, "c": 2}
    assert content(log) == {"a": 3, "b": 2, "c": 2}


def test_a_compaction_leaves_other_buckets_alone(spark, tmp_dir):
    log = log_at(spark, tmp_dir, 64)
    write(spark, log, 0, [(f"k{i}", i) for i in range(200)])
    log.compact()
    write(spark, log, 1, [("k7", 70)])
    log.compact()
    folders = lambda v: os.listdir(os.path.join(tmp_dir, "buckets=64", "base", f"v={v:012d}"))
    assert sum(x.startswith("bucket=") for x in folders(0)) > 50 and sum(x.startswith("bucket=") for x in folders(1)) == 1
    assert content(log) == {f"k{i}": 70 if i == 7 else i for i in range(200)}


def test_an_unfinished_write_is_not_seen(spark, tmp_dir):
    log = log_at(spark, tmp_dir)
    write(spark, log, 0, [("a", 1)])
    write(spark, log, 1, [("a", 2)])
    os.unlink(os.path.join(tmp_dir, "buckets=4", "deltas", f"epoch={1:012d}", "_SUCCESS"))
    assert content(log) == {"a": 1}
    with pytest.raises(ValueError, match="4 buckets"):
        log_at(spark, tmp_dir, 8)


def stream(spark, frames, path, fn, ck):
    for i, f in enumerate(frames):
        f.coalesce(1).write.mode("overwrite").parquet(f"{path}/part={i}")
    s = (spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path))
    s.writeStream.foreachBatch(fn).option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()


PROPOSALS = "id string, trigger string, action string, domain string, confidence double, evidence string, ts timestamp"


def proposals(spark, seed, n):
    rnd = random.Random(seed)
    rows = [(rnd.choice(["Use-Tests", "x", "", None]), rnd.choice(["when a", "when b"]), f"do {i}", rnd.choice([None, "d"]), rnd.choice([None, 0.5, 0.85]),
             rnd.choice([None, "seen", "again"]), f"2024-01-{1 + i // 4:02d} 10:{i % 4}0:00") for i in range(n)]
    return spark.createDataFrame(rows, PROPOSALS.replace("ts timestamp", "ts string")).withColumn("ts", F.to_timestamp("ts"))


def test_instincts_by_a_stream_equal_one_batch(spark, tmp_dir):
    whole = proposals(spark, 3, 24)
    frames = [whole.where((F.dayofmonth("ts") > lo) & (F.dayofmonth("ts") <= lo + 2)) for lo in (0, 2, 4)]
    fn = sinks.upsert_instinct_tables(tmp_dir)
    stream(spark, frames, os.path.join(tmp_dir, "in"), fn, os.path.join(tmp_dir, "ck"))
    instincts, evidence = sinks.instinct_logs(spark, tmp_dir)
    want, lines = upsert_instincts(None, whole)
    rows = lambda df, cols: sorted(map(str, df.select(*cols).collect()))
    # a first confidence with repeats in the same batch is folded alike by both
    assert rows(instincts.read(), want.columns) == rows(want, want.columns)
    assert rows(evidence.read(), ["key", "line", "ts"]) == rows(merge_evidence(None, lines), ["key", "line", "ts"])
    fn(frames[2], 2)                                             # replayed
    instincts.compact()
    assert rows(instincts.read(), want.columns) == rows(want, want.columns)


def test_answers_filed_back_by_a_stream(spark, tmp_dir):
    rows = [("What is X?", f"answer {i}", f"2024-01-0{i + 1} 10:00:00") for i in range(3)] + [("Why?", "because", "2024-01-02 11:00:00")]
    qa = spark.createDataFrame(rows, "question string, answer string, ts string").withColumn("ts", F.to_timestamp("ts"))
    frames = [qa.where(F.dayofmonth("ts") == d) for d in (1, 2, 3)]
    stream(spark, frames, os.path.join(tmp_dir, "in"), sinks.file_back_articles(tmp_dir), os.path.join(tmp_dir, "ck"))
    articles, entries = file_back_qa(qa)
    assert sorted(map(str, sinks.article_log(spark, tmp_dir).read().collect())) == sorted(map(str, articles.collect()))
    got = spark.read.parquet(os.path.join(tmp_dir, "build_log"))
    assert sorted(map(str, got.select(*entries.columns).collect())) == sorted(map(str, entries.collect()))


def test_registry_by_the_log(spark, tmp_dir):
    v = Vault(spark, SF_SMALL)
    detected = stamp_project(v["sessions"], v["registry"])
    fn = sinks.upsert_registry(tmp_dir, "2024-02-01")
    fn(detected.where("session_id % 2 = 0"), 0)
    fn(detected, 1)
    fn(detected, 1)
    got = sinks.registry_log(spark, tmp_dir).read().collect()
    assert {r.id for r in got} == {r.id for r in detected.where("id <> 'shared'").collect()} and len({r.ord for r in got}) == len(got)
