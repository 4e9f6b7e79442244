"""Streams in event order: out-of-order rows, late rows, idle keys, a restart from the checkpoint."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from lorekit.operators.observations import running_tool_calls, throttle
from lorekit.streaming import ordered, twins

ROWS = "ts timestamp, seq long, session_id string, event string"
START = dt.datetime(2024, 1, 1, 10)


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def frame(spark, rows):
    return spark.createDataFrame([(at(m), s, k, e) for m, s, k, e in rows], ROWS)


def shuffled_rows(seed, n, keys, late):
    """Batches of rows over 3 hours; each row comes up to ``late`` minutes after its time."""
    rnd = random.Random(seed)
    rows = [(rnd.randrange(0, 1800) / 10, i, f"s{rnd.randrange(keys)}", rnd.choice(["pre", "pre", "post"])) for i in range(n)]
    by = {}
    for r in rows:
        by.setdefault(int((r[0] + rnd.uniform(0, late)) // 20), []).append(r)
    return [by[k] for k in sorted(by)], rows


class Feed:
    """A folder of files, one a trigger in the order they are added, and one query over it."""

    def __init__(self, spark, root):
        self.spark, self.root, self.n = spark, root, 0

    def add(self, rows):
        self.n += 1
        path = os.path.join(self.root, "in")
        frame(self.spark, rows).coalesce(1).write.mode("append").parquet(os.path.join(path, f"part={self.n:03d}"))
        self.schema = self.spark.read.parquet(path).schema

    def run(self, job):
        s = (self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
             .parquet(os.path.join(self.root, "in")).withWatermark("ts", twins.WATERMARK))
        q = (job(s).writeStream.format("parquet").option("path", os.path.join(self.root, "out")).option("checkpointLocation", os.path.join(self.root, "ck"))
             .outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()
        return q

    def out(self):
        return self.spark.read.parquet(os.path.join(self.root, "out")).collect()


@pytest.fixture
def feed(spark, tmp_dir):
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")        # a Python worker and a store each, every batch
    yield Feed(spark, tmp_dir)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


END = [(10_000, 9_999, "end", "pre")]          # far ahead: it closes all that came before


def test_out_of_order_counts_equal_the_batch(spark, feed):
    batches, rows = shuffled_rows(1, 300, 5, 9)
    for b in [*batches, END]:
        feed.add(b)
    q = feed.run(lambda s: ordered.tool_counts_in_order(s, 20, 10))
    got = {(r.session_id, r.seq, r.tool_call_num) for r in feed.out()}
    want = {(r.session_id, r.seq, r.tool_call_num) for r in running_tool_calls(frame(spark, rows)).collect()}
    assert got == want and len(got) > 150 and ordered.dropped_rows(q) == 0
    assert all(r.hint == (r.tool_call_num >= 20 and r.tool_call_num % 10 == 0) for r in feed.out())


def test_out_of_order_throttle_equals_the_batch(spark, feed):
    batches, rows = shuffled_rows(2, 300, 4, 9)
    for b in [*batches, END]:
        feed.add(b)
    feed.run(lambda s: ordered.throttle_in_order(s, "session_id", 600))
    got = {(r.key, r.seq) for r in feed.out()}
    want = {(r.session_id, r.seq) for r in throttle(frame(spark, rows), "session_id", 600).collect()}
    assert got == want and len(got) > 20


def test_rows_behind_the_watermark_are_counted_as_dropped(spark, feed):
    feed.add([(30, 1, "a", "pre"), (22, 2, "a", "pre")])
    feed.add([(21, 3, "a", "pre"), (60, 4, "a", "pre")])       # 21 is ahead of the watermark of 20
    feed.add([(61, 8, "c", "pre")])
    feed.add([(49, 5, "a", "pre"), (50, 6, "b", "pre"), (55, 7, "b", "pre")])       # the batch before had one of 50
    feed.add(END)
    q = feed.run(lambda s: ordered.tool_counts_in_order(s))
    assert sorted((r.session_id, r.tool_call_num, r.seq) for r in feed.out()) == [("a", 1, 3), ("a", 2, 2), ("a", 3, 1), ("a", 4, 4), ("b", 1, 7), ("c", 1, 8)]
    assert ordered.dropped_rows(q) == 2


def test_rows_wait_until_the_watermark_has_passed_them(spark, feed):
    feed.add([(0, 1, "a", "pre"), (15, 2, "a", "pre")])
    feed.run(lambda s: ordered.tool_counts_in_order(s))
    assert [r.seq for r in feed.out()] == [1]
    feed.add([(10, 3, "a", "pre"), (40, 4, "a", "pre")])        # a restart: the second run goes on from the checkpoint
    feed.run(lambda s: ordered.tool_counts_in_order(s))
    assert sorted((r.seq, r.tool_call_num) for r in feed.out()) == [(1, 1), (2, 3), (3, 2)]
    feed.add(END)
    feed.run(lambda s: ordered.tool_counts_in_order(s))
    assert sorted((r.seq, r.tool_call_num) for r in feed.out()) == [(1, 1), (2, 3), (3, 2), (4, 4)]


def state(spark, feed, name):
    s = spark.read.format("statestore").option("path", os.path.join(feed.root, "ck")).option("stateVarName", name).load()
    return {r.key[0] for r in s.collect()}


def test_idle_keys_leave_the_state(spark, feed):
    feed.add([(0, 1, "a", "pre"), (1, 2, "a", "pre"), (2, 3, "b", "pre")])
    feed.add([(100, 4, "b", "pre")])
    feed.add([(130, 5, "c", "pre"), (125, 6, "c", "pre")])
    job = lambda s: ordered.tool_counts_in_order(s, idle_hours=1)
    feed.run(job)
    assert state(spark, feed, "memo") == {"b"}                  # a had its last call two hours ago; c waits
    assert state(spark, feed, "pending") == {"c"}
    feed.add([(150, 7, "a", "pre")])
    feed.add(END)
    feed.run(job)
    assert sorted((r.session_id, r.seq, r.tool_call_num) for r in feed.out()) == [
        ("a", 1, 1), ("a", 2, 2), ("a", 7, 1), ("b", 3, 1), ("b", 4, 1), ("c", 5, 2), ("c", 6, 1)]


def test_a_throttle_forgets_keys_after_its_interval(spark, feed):
    feed.add([(0, 1, "a", "pre"), (3, 2, "b", "pre"), (60, 3, "c", "pre")])
    feed.run(lambda s: ordered.throttle_in_order(s, "session_id", 1200))
    assert state(spark, feed, "memo") == set() and state(spark, feed, "pending") == {"c"}
    assert {(r.key, r.seq) for r in feed.out()} == {("a", 1), ("b", 2)}
