"""Structured Streaming twins of the batch jobs.

Observations, session ends and daily logs arrive as append-only files; each
twin reads them with ``readStream`` and keeps only small per-key state. Each
has a batch job in ``lorekit.operators`` that gives the same answer when the
stream is replayed in event order (the tests check this)."""

from __future__ import annotations

from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lorekit.functions.text import redact
from lorekit.operators.observations import COMPACT_INTERVAL, COMPACT_THRESHOLD, classify_tool_results, summarize_tool_events
from lorekit.session import path_exists
from lorekit.sources.adapters import observations_from_events
from lorekit.sources.scan import read_version, write_version

WATERMARK = "10 minutes"


def read_events_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Event files (parquet) as a stream; the schema is taken from what is there."""
    schema = spark.read.parquet(path).schema
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(path)


def stream_observations(events: DataFrame) -> DataFrame:
    """Redacted observation rows with a watermark on ``ts`` and a ``date`` partition column."""
    obs = (observations_from_events(events).withColumn("input_summary", redact("input_summary"))
           .withColumn("ts", F.col("ts").cast("timestamp")))      # event time must be TIMESTAMP (UTC session)
    return obs.withWatermark("ts", WATERMARK).withColumn("date", F.to_date("ts"))


def stream_hook_observations(hooks: DataFrame) -> DataFrame:
    """Observations of raw hook payloads (ts, seq, session_id, project, event, tool,
    tool_input and tool_response as JSON text): the input is summarised and
    redacted on ``pre`` events, the response classified on ``post`` events, with the
    watermark and ``date`` column of ``stream_observations``."""
    h = hooks.withColumn("tool_response", F.try_parse_json("tool_response"))
    h = classify_tool_results(summarize_tool_events(h))
    pre, post = F.col("event") == "pre", F.col("event") == "post"
    obs = h.select(F.col("ts").cast("timestamp").alias("ts"), "seq", "session_id", "project", "event", "tool",
                   F.when(pre, F.col("input_summary")).alias("input_summary"), F.when(post, F.col("success")).alias("success"),
                   F.when(post, redact("error")).alias("error"))
    return obs.withWatermark("ts", WATERMARK).withColumn("date", F.to_date("ts"))


def sink_observations(obs: DataFrame, path: str, checkpoint: str, rows_per_file: int | None = None):
    """Append to a date-partitioned parquet table (file sink, exactly-once through
    the checkpoint), in files of at most ``rows_per_file`` rows. Small files of past
    days are rotated out by ``archive.archive_observations``."""
    writer = (obs.writeStream.format("parquet").option("checkpointLocation", checkpoint)
              .partitionBy("date").outputMode("append").trigger(availableNow=True))
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    return writer.start(path)


# ── Keyed state: running tool-call counts and compact hints ───────────

COUNT_OUT = "session_id string, seq long, tool_call_num long, hint boolean"
COUNT_STATE = "n long"


def _count_calls(threshold: int, interval: int):
    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        batch = pd.concat(list(pdfs), ignore_index=True)
        pre = batch[batch["event"] == "pre"].sort_values(["ts", "seq"])
        nums = n + pd.RangeIndex(1, len(pre) + 1).to_numpy()
        state.update((int(n + len(pre)),))
        hint = (nums == threshold) | ((nums > threshold) & ((nums - threshold) % interval == 0))
        yield pd.DataFrame({"session_id": key[0], "seq": pre["seq"].to_numpy(), "tool_call_num": nums, "hint": hint})
    return fn


def stream_tool_counts(obs: DataFrame, threshold: int = COMPACT_THRESHOLD, interval: int = COMPACT_INTERVAL) -> DataFrame:
    """Per-session call numbers of ``pre`` events; state is one counter per session.
    Inside a micro-batch the session's events are ordered by (ts, seq)."""
    return (obs.select("session_id", "seq", "ts", "event").groupBy("session_id")
            .applyInPandasWithState(_count_calls(threshold, interval), COUNT_OUT, COUNT_STATE, "append",
                                    GroupStateTimeout.NoTimeout))


# ── Keyed state: throttle ─────────────────────────────────────────────

THROTTLE_OUT = "key string, seq long, ts timestamp"
THROTTLE_STATE = "last_us long"


def _throttle(interval_us: int):
    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        batch = pd.concat(list(pdfs), ignore_index=True).sort_values(["ts", "seq"])
        us = batch["ts"].astype("datetime64[us]").astype("int64").to_numpy()
        keep = []
        for i, t in enumerate(us):            # greedy: compare with the last *accepted* event
            if last is None or t - last >= interval_us:
                keep.append(i)
                last = int(t)
        if last is not None:
            state.update((last,))
        acc = batch.iloc[keep]
        yield pd.DataFrame({"key": key[0], "seq": acc["seq"].to_numpy(), "ts": acc["ts"].to_numpy()})
    return fn


def stream_throttle(events: DataFrame, key: str, interval_seconds: int, ts: str = "ts", seq: str = "seq") -> DataFrame:
    """Greedy cooldown per key with the last accepted time as state."""
    e = events.select(F.col(key).cast("string").alias("key"), F.col(seq).cast("long").alias("seq"), F.col(ts).alias("ts"))
    return e.groupBy("key").applyInPandasWithState(_throttle(interval_seconds * 1_000_000), THROTTLE_OUT, THROTTLE_STATE,
                                                  "append", GroupStateTimeout.NoTimeout)


# ── Windows ───────────────────────────────────────────────────────────

def stream_recent_window(obs: DataFrame, hours: int = 24, slide: str = "1 hour", min_count: int = 20) -> DataFrame:
    """Observation counts in sliding ``hours`` windows (hourly grain), kept when the
    synthesis gate would open. Expects the watermarked stream of
    ``stream_observations``; late rows beyond the watermark are dropped."""
    w = F.window("ts", f"{hours} hours", slide)
    return (obs.groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= min_count)
            .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n"))


# ── foreachBatch upserts ──────────────────────────────────────────────

REGISTRY_ROWS = ("ord int, id string, name string, canonical string, aliases array<string>, root string, remote string, "
                 "auto_registered string, notes string")
STATE_ROWS = "name string, hash string, epoch long"


def register_projects_batch(table_root: str, as_of_date: str):
    """foreachBatch body: insert-if-absent of detected projects. Batch n writes
    version n + 1 of the registry from the newest version below it (none on a first
    run), so a replayed batch rewrites its own version from the same input; a
    single writer replaces the lock."""
    from lorekit.operators.scope import register_projects

    def fn(batch: DataFrame, epoch_id: int) -> None:
        cur = read_version(batch.sparkSession, table_root, REGISTRY_ROWS, below=epoch_id + 1)
        old = cur.select("id", F.col("auto_registered").alias("old_auto"), F.col("notes").alias("old_notes"))
        out = register_projects(cur.drop("auto_registered", "notes"), batch, as_of_date).join(old, "id", "left")
        out = out.withColumn("auto_registered", F.coalesce("auto_registered", "old_auto")).withColumn("notes", F.coalesce("notes", "old_notes"))
        write_version(out.select(*cur.columns), table_root, epoch_id + 1)
    return fn


def incremental_compile_batch(state_path: str):
    """foreachBatch body: dailies (name, sha16) whose hash differs from the newest
    record of an earlier batch get a record. Each batch has its own ``epoch``
    partition, which a replay overwrites."""
    def fn(batch: DataFrame, epoch_id: int) -> None:
        cur = latest_state(batch.sparkSession, state_path, below=epoch_id)
        d = batch.select("name", F.col("sha16").alias("hash"))
        changed = d.join(cur.select("name", F.col("hash").alias("recorded")), "name", "left").where(
            ~F.col("recorded").eqNullSafe(F.col("hash"))).select("name", "hash")
        changed.write.mode("overwrite").parquet(f"{state_path.rstrip('/')}/epoch={epoch_id}")
    return fn


def latest_state(spark: SparkSession, state_path: str, below: int | None = None) -> DataFrame:
    """The compile state (name, hash): the newest record per daily, of the batches
    before ``below``; no rows where there is no state yet."""
    found = path_exists(spark, f"{state_path.rstrip('/')}/epoch=*")
    s = spark.read.schema(STATE_ROWS).parquet(state_path) if found else spark.createDataFrame([], STATE_ROWS)
    if below is not None:
        s = s.where(F.col("epoch") < below)
    return s.groupBy("name").agg(F.max_by("hash", "epoch").alias("hash"))
