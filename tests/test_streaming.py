"""Batch = stream: replay the events through each streaming twin (availableNow)
and compare with the batch job."""

import os

from pyspark.sql import functions as F

from conftest import SF_SMALL
from lorekit.operators.observations import running_tool_calls, throttle
from lorekit.sources.adapters import load, observations_from_events
from lorekit.sources.scan import read_version, write_version
from lorekit.streaming import twins


def _events_dir(spark, tmp_dir):
    """The events as three files written one after another in time order, so a
    one-file-per-trigger stream replays them in event order across micro-batches."""
    ev = load(spark, SF_SMALL, "events")
    out = os.path.join(tmp_dir, "events")
    for lo, hi in (("2024-01-01", "2024-01-11"), ("2024-01-11", "2024-01-21"), ("2024-01-21", "2024-02-01")):
        ev.where((F.col("ts") >= lo) & (F.col("ts") < hi)).coalesce(1).write.mode("append").parquet(out)
    return out


def _run_to_memory(df, name, ckpt):
    q = (df.writeStream.format("memory").queryName(name).outputMode("append")
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_tool_counts_stream_equals_batch(spark, tmp_dir):
    ev = twins.read_events_stream(spark, _events_dir(spark, tmp_dir), max_files=1)
    s = _run_to_memory(twins.stream_tool_counts(twins.stream_observations(ev), 20, 10), "tc", os.path.join(tmp_dir, "c1"))
    got = {(r["session_id"], r["seq"], r["tool_call_num"]) for r in s.collect()}
    b = running_tool_calls(observations_from_events(load(spark, SF_SMALL, "events")))
    want = {(r["session_id"], r["seq"], r["tool_call_num"]) for r in b.collect()}
    assert got == want and len(got) > 0


def test_throttle_stream_equals_batch(spark, tmp_dir):
    ev = twins.read_events_stream(spark, _events_dir(spark, tmp_dir), max_files=1)
    obs = twins.stream_observations(ev)
    s = _run_to_memory(twins.stream_throttle(obs, "session_id", 6 * 3600), "th", os.path.join(tmp_dir, "c2"))
    got = {(r["key"], r["seq"]) for r in s.collect()}
    b = throttle(observations_from_events(load(spark, SF_SMALL, "events")), "session_id", 6 * 3600)
    want = {(r["session_id"], r["seq"]) for r in b.collect()}
    assert got == want and len(got) > 0


def test_observation_sink_equals_batch(spark, tmp_dir):
    ev = twins.read_events_stream(spark, _events_dir(spark, tmp_dir), max_files=1)
    out, ck = os.path.join(tmp_dir, "obs"), os.path.join(tmp_dir, "c3")
    twins.sink_observations(twins.stream_observations(ev), out, ck).awaitTermination()
    got = spark.read.parquet(out)
    b = observations_from_events(load(spark, SF_SMALL, "events"))
    assert got.count() == b.count()
    assert got.select("seq").subtract(b.select("seq")).count() == 0


def test_incremental_compile_batches(spark, tmp_dir):
    from lorekit.operators.dailies import pending_dailies
    from lorekit.sources.adapters import dailies_from_events, state_from_dailies
    d = dailies_from_events(load(spark, SF_SMALL, "events"))
    state_path = os.path.join(tmp_dir, "state")
    state_from_dailies(d).withColumn("epoch", F.lit(-1).cast("long")).write.partitionBy("epoch").parquet(state_path)
    fn = twins.incremental_compile_batch(state_path)
    fn(d, 0)
    st = twins.latest_state(spark, state_path)
    assert pending_dailies(d, st).count() == 0
    fn(d, 1)                                  # idempotent: nothing changes the second time
    assert spark.read.parquet(state_path).where("epoch = 1").count() == 0


def test_recent_window_stream_equals_batch_counts(spark, tmp_dir):
    ev = twins.read_events_stream(spark, _events_dir(spark, tmp_dir), max_files=1)
    s = _run_to_memory(twins.stream_recent_window(twins.stream_observations(ev), min_count=1), "rw",
                       os.path.join(tmp_dir, "c4"))
    got = {(r["start"], r["n"]) for r in s.collect()}
    # batch twin: the same sliding windows over the whole table; the stream emits only closed windows
    b = observations_from_events(load(spark, SF_SMALL, "events")).withColumn("ts", F.col("ts").cast("timestamp"))
    w = b.groupBy(F.window("ts", "24 hours", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    want = {(r["w"]["start"], r["n"]) for r in w.collect()}
    assert got and got <= want


def test_register_projects_batch_is_idempotent(spark, tmp_dir):
    from lorekit.operators.scope import stamp_project
    from lorekit.plans.vault import Vault
    v = Vault(spark, SF_SMALL)
    reg_path = os.path.join(tmp_dir, "registry")
    read = lambda: read_version(spark, reg_path, twins.REGISTRY_ROWS)
    write_version(v["registry"].withColumn("auto_registered", F.lit(None).cast("string")).withColumn(
        "notes", F.lit(None).cast("string")), reg_path, 0)
    detected = stamp_project(v["sessions"], v["registry"])
    fn = twins.register_projects_batch(reg_path, "2024-02-01")
    fn(detected, 0)
    first = sorted(map(str, read().collect()))
    fn(detected, 0)                           # replayed
    assert sorted(map(str, read().collect())) == first
    fn(detected, 1)
    assert sorted(map(str, read().collect())) == first and len(first) > v["registry"].count()


def _stream_files(spark, frames, path):
    for i, f in enumerate(frames):
        f.coalesce(1).write.parquet(f"{path}/part={i}")
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


def test_registration_by_a_stream_from_nothing(spark, tmp_dir):
    schema = "session_id long, id string, name string, root string, remote string"
    frames = [spark.createDataFrame(rows, schema) for rows in (
        [(1, "b", "beta", "/b", None), (2, "shared", "shared", None, None)], [(3, "b", "other", "/x", None), (4, "a", "alpha", "/a", None)], [(5, "c", "gamma", None, None)])]
    root = os.path.join(tmp_dir, "registry")
    s = _stream_files(spark, frames, os.path.join(tmp_dir, "in"))
    for _ in range(2):                        # the second run finds nothing new
        (s.writeStream.foreachBatch(twins.register_projects_batch(root, "2024-02-01")).option("checkpointLocation", os.path.join(tmp_dir, "ck"))
         .trigger(availableNow=True).start().awaitTermination())
        rows = sorted((r.ord, r.id, r.name, r.auto_registered) for r in read_version(spark, root, twins.REGISTRY_ROWS).collect())
        assert [r[1] for r in rows] == ["b", "a", "c"] and {r[3] for r in rows} == {"2024-02-01"} and rows[0][2] == "beta"


def test_compile_state_by_a_stream_from_nothing(spark, tmp_dir):
    frames = [spark.createDataFrame(rows, "name string, sha16 string") for rows in ([("a", "1"), ("b", "1")], [("a", "1"), ("b", "2")], [("c", "1")])]
    path = os.path.join(tmp_dir, "state")
    fn = twins.incremental_compile_batch(path)
    (_stream_files(spark, frames, os.path.join(tmp_dir, "in")).writeStream.foreachBatch(fn)
     .option("checkpointLocation", os.path.join(tmp_dir, "ck")).trigger(availableNow=True).start().awaitTermination())
    want = {("a", "1"), ("b", "2"), ("c", "1")}
    assert {tuple(r) for r in twins.latest_state(spark, path).collect()} == want
    fn(frames[1], 1)                          # replayed
    assert {tuple(r) for r in twins.latest_state(spark, path).collect()} == want
    assert spark.read.parquet(path).count() == 4


def test_hook_payloads_by_a_stream(spark, tmp_dir):
    rows = [("2024-01-01 10:00:00", 1, "s", "P", "pre", "Bash", '{"command": "export token=abcdefghij", "x": 1}', None),
            ("2024-01-01 10:00:01", 2, "s", "P", "post", "Bash", None, '{"isError": true, "error": "boom"}'),
            ("2024-01-01 10:00:02", 3, "s", "P", "post", "Bash", "broken {", '"ok"')]
    df = spark.createDataFrame(rows, "ts string, seq long, session_id string, project string, event string, tool string, tool_input string, tool_response string")
    s = _stream_files(spark, [df.limit(2), df.where("seq = 3")], os.path.join(tmp_dir, "in"))
    out = os.path.join(tmp_dir, "obs")
    twins.sink_observations(twins.stream_hook_observations(s), out, os.path.join(tmp_dir, "ck")).awaitTermination()
    got = {r.seq: (r.input_summary, r.success, r.error, str(r.date)) for r in spark.read.parquet(out).collect()}
    assert got == {1: ("command=export token=[REDACTED] x=1", None, None, "2024-01-01"), 2: (None, False, "boom", "2024-01-01"),
                   3: (None, True, None, "2024-01-01")}


def test_rows_behind_the_watermark_are_dropped(spark, tmp_dir):
    at = lambda *hours: spark.createDataFrame([(f"2024-01-01 {h:02d}:30:00", i) for i, h in enumerate(hours)], "ts string, n int").select(
        F.col("ts").cast("timestamp").alias("ts"))
    s = _stream_files(spark, [at(1, 2), at(20, 21), at(1, 22), at(23)], os.path.join(tmp_dir, "in"))
    w = twins.stream_recent_window(s.withWatermark("ts", twins.WATERMARK), hours=1, min_count=1)
    got = {str(r.start)[11:13]: r.n for r in _run_to_memory(w, "late", os.path.join(tmp_dir, "ck")).collect()}
    assert got["01"] == 1 and got["20"] == 1      # the second row of 01:30 came 19 hours late


def test_scan_transcripts(spark, tmp_dir):
    from lorekit.operators.transcripts import flatten_turns, scan_transcripts
    d = os.path.join(tmp_dir, "t")
    os.makedirs(d)
    with open(os.path.join(d, "s1.jsonl"), "w") as f:
        f.write('{"type": "user", "message": {"role": "user", "content": "Hello"}}\n'
                '{"type": "assistant", "message": {"role": "assistant", "content": "Hi"}}\n'
                '{"type": "user", "message": {"role": "user", "content": "Q"}}\n'
                '{"type": "assistant", "message": {"role": "assistant", "content": "A"}}\n')
    t = flatten_turns(scan_transcripts(spark, d)).orderBy("seq").collect()
    assert [(r["session_id"], r["role"], r["text"]) for r in t] == [
        ("s1", "user", "Hello"), ("s1", "assistant", "Hi"), ("s1", "user", "Q"), ("s1", "assistant", "A")]
