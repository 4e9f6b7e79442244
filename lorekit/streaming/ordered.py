"""Keyed streams in event order.

Rows of a key wait in a list state (RocksDB, so on disk) until the watermark has passed them and then go through the
fold in (ts, seq) order, whatever order they came in; an event-time timer wakes a key whose rows are due. Rows that
come behind the watermark never reach the state: Spark drops and counts them (``dropped_rows``). So a replay in any
order within the watermark's delay gives what the batch job gives. Keys that have been idle long enough leave the
state, again by event time.

The twins in ``lorekit.streaming.twins`` answer at once, in the order of arrival; these answer once that is certain."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from lorekit.operators.observations import COMPACT_INTERVAL, COMPACT_THRESHOLD

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COUNTED = "session_id string, seq long, ts timestamp, tool_call_num long, hint boolean"
ACCEPTED = "key string, seq long, ts timestamp"


def use_disk_state(spark: SparkSession) -> None:
    """Keep the state of the streams that this session starts from now on in RocksDB, as keyed state with timers needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def dropped_rows(query) -> int:
    """Rows that a query has dropped behind the watermark, of the progress reports it still has."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


class InOrder(StatefulProcessor):
    """Buffers rows (us, seq) and hands those that the watermark has passed to ``fold`` in order.

    State per key: ``pending`` (the rows that wait) and ``memo`` (the fold's number, time of the last row folded)."""

    #: Microseconds after a key's last row when its memo may go; None keeps it.
    idle_us: int | None = None

    def fold(self, key, memo: int | None, rows: list[tuple[int, int]]) -> tuple[int | None, pd.DataFrame]:
        raise NotImplementedError

    def init(self, handle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "us long, seq long")
        self.memo = handle.getValueState("memo", "value long, us long")

    def handleInputRows(self, key, rows, timerValues):
        new = []
        for part in rows:
            us = part["ts"].astype("datetime64[us]").astype("int64")
            new += zip(us.tolist(), part["seq"].tolist())
        if new:
            self.pending.appendList(new)
        yield from self._due(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self._due(key, timerValues.getCurrentWatermarkInMs())

    def _idle(self, last: int | None, us: int) -> bool:
        return self.idle_us is not None and last is not None and us - last >= self.idle_us

    def _spells(self, rows):
        """The rows, cut where the key was idle: what is forgotten hangs on event times alone, not on the batches."""
        spell = []
        for r in rows:
            if spell and self._idle(spell[-1][0], r[0]):
                yield spell
                spell = []
            spell.append(r)
        yield spell

    def _due(self, key, watermark_ms: int):
        rows = sorted(tuple(r) for r in self.pending.get())
        due = [r for r in rows if r[0] <= 1000 * watermark_ms]
        rest = rows[len(due):]
        value, last = self.memo.get() if self.memo.exists() else (None, None)
        if due:
            for rows in self._spells(due):
                value, out = self.fold(key, None if self._idle(last, rows[0][0]) else value, rows)
                last = rows[-1][0]
                yield out
            if value is not None:
                self.memo.update((value, last))
            if rest:
                self.pending.put(rest)
            else:
                self.pending.clear()
        if rest:
            self.handle.registerTimer(-(-rest[0][0] // 1000))
        elif last is not None and self.idle_us is not None:
            gone = -(-(last + self.idle_us) // 1000)
            if gone <= watermark_ms:
                self.memo.clear()
            else:
                self.handle.registerTimer(gone)

    def close(self) -> None:
        pass


class ToolCounts(InOrder):
    """Numbers a session's calls from 1; the memo is the count so far."""

    def __init__(self, threshold: int, interval: int, idle_us: int | None):
        self.threshold, self.interval, self.idle_us = threshold, interval, idle_us

    def fold(self, key, memo, rows):
        first = (memo or 0) + 1
        nums = list(range(first, first + len(rows)))
        hint = [n == self.threshold or n > self.threshold and (n - self.threshold) % self.interval == 0 for n in nums]
        return nums[-1], pd.DataFrame({"session_id": key[0], "seq": [s for _, s in rows], "ts": pd.to_datetime([u for u, _ in rows], unit="us"),
                                       "tool_call_num": nums, "hint": hint})


class Throttle(InOrder):
    """Accepts a row at least ``interval_us`` after the last accepted one, whose time is the memo. It may go after
    that interval: what comes later is accepted with or without it."""

    def __init__(self, interval_us: int):
        self.interval_us = self.idle_us = interval_us

    def fold(self, key, memo, rows):
        keep = []
        for us, seq in rows:
            if memo is None or us - memo >= self.interval_us:
                keep.append((us, seq))
                memo = us
        return memo, pd.DataFrame({"key": key[0], "seq": [s for _, s in keep], "ts": pd.to_datetime([u for u, _ in keep], unit="us")},
                                  columns=["key", "seq", "ts"])


def tool_counts_in_order(obs: DataFrame, threshold: int = COMPACT_THRESHOLD, interval: int = COMPACT_INTERVAL,
                         idle_hours: float | None = None) -> DataFrame:
    """(session_id, seq, ts, tool_call_num, hint) of the ``pre`` events of a watermarked stream, numbered per session
    in (ts, seq) order. A session without a call for ``idle_hours`` is forgotten and starts again at 1."""
    idle = None if idle_hours is None else int(idle_hours * 3_600_000_000)
    calls = obs.where(F.col("event") == "pre").select(F.col("session_id").cast("string").alias("session_id"), F.col("seq").cast("long").alias("seq"), "ts")
    use_disk_state(obs.sparkSession)
    return calls.groupBy("session_id").transformWithStateInPandas(ToolCounts(threshold, interval, idle), COUNTED, "Append", "EventTime")


def throttle_in_order(events: DataFrame, key: str, interval_seconds: int, ts: str = "ts", seq: str = "seq") -> DataFrame:
    """(key, seq, ts) of the events that a greedy cooldown per key accepts, in (ts, seq) order, of a watermarked stream."""
    rows = events.select(F.col(key).cast("string").alias("key"), F.col(seq).cast("long").alias("seq"), F.col(ts).alias("ts"))
    use_disk_state(events.sparkSession)
    return rows.groupBy("key").transformWithStateInPandas(Throttle(interval_seconds * 1_000_000), ACCEPTED, "Append", "EventTime")
