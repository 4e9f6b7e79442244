"""Tool observations: summaries, result classes, running counts, windows, tails
and the greedy per-key throttle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekit.functions.text import redact
from lorekit.session import cut_lineage, ensure_checkpoint_dir

# ── Fixed values ──────────────────────────────────────────────────────
KEY_ORDER = ["file_path", "path", "command", "pattern", "url", "query",
             "old_string", "new_string", "prompt", "description", "content"]
LISTED_CUT, OTHER_CUT, SUMMARY_CUT, ERROR_CUT = 120, 60, 500, 160
COMPACT_THRESHOLD, COMPACT_INTERVAL = 50, 25
SYNTH_MIN_OBS, SYNTH_WINDOW_HOURS, TAIL_K = 20, 24, 200


# ── Raw hook events (VARIANT) ─────────────────────────────────────────

def _in_document_order(text: F.Column) -> F.Column:
    """(key, value) entries of a JSON object as text, in the order of the text; null for anything else. A repeated key
    keeps its first place and takes its last value."""
    es = F.map_entries(F.from_json(text, "map<string,variant>"))
    keys = F.transform(es, lambda e: e["key"])
    last = F.transform(F.array_distinct(keys), lambda k: F.element_at(F.filter(es, lambda e: e["key"] == k), -1))
    return F.when(F.size(F.array_distinct(keys)) < F.size(keys), last).otherwise(es)


def summarize_tool_events(raw: DataFrame, input_col: str = "tool_input") -> DataFrame:
    """input_summary: listed keys first in fixed order (strings cut to 120, numbers
    and booleans verbatim, lists ``[n items]``), then the other scalar keys
    cut to 60; joined by spaces, cut to 500, then redacted. A non-object input
    becomes its text, redacted, cut to 500.

    The other keys come in the order of the document where the input is JSON text; a
    VARIANT has lost that order, so there they come in key order."""
    c, is_text = F.col(input_col), dict(raw.dtypes)[input_col] == "string"
    es = _in_document_order(c) if is_text else F.map_entries(F.try_variant_get(c, "$", "map<string,variant>"))
    value = F.try_parse_json(c) if is_text else c
    # type each entry once; the formatting below only reads the cached type string
    entries = F.transform(es, lambda e, i: F.struct(
        e["key"].alias("key"), e["value"].alias("value"), F.schema_of_variant(e["value"]).alias("t"), i.alias("i")))
    order = F.array(*[F.lit(k) for k in KEY_ORDER])

    def scalar_text(v, t, cut):
        x = (F.when(t == "BOOLEAN", F.when(F.try_variant_get(v, "$", "boolean"), "True").otherwise("False"))
             .otherwise(F.try_variant_get(v, "$", "string")))
        return F.substring(x, 1, cut) if cut else x

    def part(e):
        k, v, t = e["key"], e["value"], e["t"]
        pos = F.array_position(order, k)
        listed = pos > 0
        is_scalar = t.isin("STRING", "BOOLEAN", "BIGINT", "DOUBLE", "FLOAT", "INT") | t.startswith("DECIMAL")
        text = (F.when(listed & (t == "STRING"), F.concat(k, F.lit("="), scalar_text(v, t, LISTED_CUT)))
                .when(listed & is_scalar, F.concat(k, F.lit("="), scalar_text(v, t, None)))
                .when(listed & t.startswith("ARRAY"),
                      F.concat(k, F.lit("=["), F.size(F.try_variant_get(v, "$", "array<variant>")).cast("string"),
                               F.lit(" items]")))
                .when(~listed & is_scalar, F.concat(k, F.lit("="), scalar_text(v, t, OTHER_CUT))))
        rank = F.when(listed, pos - len(KEY_ORDER) - 1).otherwise(e["i"])
        return F.struct(rank.alias("r"), k.alias("k"), text.alias("t"))

    parts = F.filter(F.transform(entries, part), lambda p: p["t"].isNotNull())
    joined = F.array_join(F.transform(F.array_sort(parts), lambda p: p["t"]), " ")
    summary = F.when(es.isNotNull(), redact(F.substring(joined, 1, SUMMARY_CUT))).otherwise(
        F.substring(redact(F.coalesce(F.try_variant_get(value, "$", "string"), F.lit(""))), 1, SUMMARY_CUT))
    return raw.withColumn("input_summary", summary)


def classify_tool_results(raw: DataFrame, response_col: str = "tool_response") -> DataFrame:
    """success/error: failure when ``isError`` or ``error`` is truthy; message is
    ``error`` (else ``tool_error``) cut to 160; a non-object response is a success."""
    r = F.col(response_col)
    is_obj = r.isNotNull() & F.schema_of_variant(r).startswith("OBJECT")

    def truthy(path):
        v = F.try_variant_get(r, path, "variant")
        t = F.schema_of_variant(v)
        return (v.isNotNull() & (
            ((t == "BOOLEAN") & F.coalesce(F.try_variant_get(r, path, "boolean"), F.lit(False)))
            | ((t == "STRING") & (F.try_variant_get(r, path, "string") != ""))
            | ((t.startswith("DECIMAL") | t.isin("BIGINT", "DOUBLE", "INT")) & (F.try_variant_get(r, path, "double") != 0))
            | (t.startswith("ARRAY") & (F.size(F.try_variant_get(r, path, "array<variant>")) > 0))
            | (t.startswith("OBJECT") & (t != "OBJECT<>"))))
    failed = is_obj & (truthy("$.isError") | truthy("$.error"))
    err = F.when(truthy("$.error"), F.try_variant_get(r, "$.error", "string")).otherwise(F.lit("tool_error"))
    return raw.withColumn("success", ~failed).withColumn(
        "error", F.when(failed, F.substring(err, 1, ERROR_CUT)))


# ── Batch jobs over the observation table ─────────────────────────────

def running_tool_calls(obs: DataFrame, bucket: str = "1 hour") -> DataFrame:
    """Per-session call number of each ``pre`` event in (ts, seq) order.

    Skew-safe prefix count: rows are numbered inside (session, time bucket)
    partitions, and each bucket is offset by the counts of the session's earlier
    buckets (a small aggregate), so one hot session is spread over many tasks."""
    pre = obs.where(F.col("event") == "pre").withColumn("bucket", F.date_trunc("hour", "ts") if bucket == "1 hour"
                                                         else F.window("ts", bucket)["start"])
    inb = pre.withColumn("i", F.row_number().over(Window.partitionBy("session_id", "bucket").orderBy("ts", "seq")))
    counts = pre.groupBy("session_id", "bucket").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("session_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.withColumn("off", F.coalesce(F.sum("c").over(w), F.lit(0))).select("session_id", "bucket", "off")
    return (inb.join(offs, ["session_id", "bucket"])
            .withColumn("tool_call_num", (F.col("off") + F.col("i")).cast("bigint")).drop("bucket", "i", "off"))


def compact_hints(calls: DataFrame, threshold: int = COMPACT_THRESHOLD, interval: int = COMPACT_INTERVAL) -> DataFrame:
    n = F.col("tool_call_num")
    return calls.where((n == threshold) | ((n > threshold) & ((n - threshold) % interval == 0)))


def filter_recent(obs: DataFrame, as_of: str, hours: int = SYNTH_WINDOW_HOURS) -> DataFrame:
    """``ts >= as_of − hours`` (inclusive); a literal bound, so it reaches the scan."""
    return obs.where(F.col("ts") >= F.expr(f"timestamp'{as_of}' - INTERVAL {int(hours)} HOURS"))


def gate_min_count(df: DataFrame, n: int = SYNTH_MIN_OBS) -> DataFrame:
    """All rows if there are at least ``n``, else none: the count is a scalar
    subquery (computed once, partially aggregated), so nothing is pulled into a
    single partition."""
    return df.where(df.agg(F.count(F.lit(1))).scalar() >= n)


def observation_tail(obs: DataFrame, k: int = TAIL_K) -> DataFrame:
    """The last ``k`` observations by arrival, then successful posts dropped; each as
    a prompt line. The top-k is a bounded per-partition heap (TakeOrderedAndProject)."""
    last = obs.orderBy(F.col("ts").desc(), F.col("seq").desc()).limit(k)
    keep = last.where((F.col("event") == "pre")
                      | ((F.col("event") == "post") & ~F.coalesce(F.col("success"), F.lit(True))))
    head = F.concat(F.lit("["), F.substring(F.coalesce("session_id", F.lit("?")), 1, 8), F.lit("/"),
                    F.coalesce(F.nullif("project", F.lit("")), F.lit("-")), F.lit("] "))
    line = F.when(F.col("event") == "pre", F.concat(
        head, F.lit("PRE "), F.coalesce("tool", F.lit("-")), F.lit(": "),
        F.substring(F.coalesce("input_summary", F.lit("")), 1, 140))).otherwise(F.concat(
            head, F.lit("POST "), F.coalesce("tool", F.lit("-")), F.lit(": ERR "),
            F.substring(F.coalesce(F.nullif("error", F.lit("")), F.lit("error")), 1, 80)))
    return keep.select("ts", "seq", line.alias("line"))


# ── Greedy throttle ───────────────────────────────────────────────────

SPAN_SECONDS = 3600          # width of the time spans that split a hot key

def _next_allowed(e: DataFrame, interval_seconds: int, span_seconds: int = SPAN_SECONDS) -> DataFrame:
    """For each event, the first event of the same key at or after ts + interval:
    events and probes merged in descending time order with a running
    ``last(ignorenulls)`` (an O(n) frame that spills, never a collect). The window
    runs within spans of time, so a hot key is many small partitions; a probe with
    no event after it in its span takes the first event of the next span that has
    one, from a table of one row per key and span."""
    probes = e.select("k", (F.col("ts") + F.expr(f"INTERVAL {int(interval_seconds)} SECONDS")).alias("t"),
                      F.lit(0).alias("kind"), F.col("seq").alias("src"), F.lit(None).cast("long").alias("ev"))
    evs = e.select("k", F.col("ts").alias("t"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("src"),
                   F.col("seq").cast("long").alias("ev"))
    u = probes.unionByName(evs).withColumn("span", F.floor(F.unix_seconds(F.col("t").cast("timestamp")) / span_seconds))
    w = (Window.partitionBy("k", "span").orderBy(F.col("t").desc(), F.col("kind").desc(), F.col("ev").desc())
         .rowsBetween(Window.unboundedPreceding, 0))
    spans = u.groupBy("k", "span").agg(F.min_by("ev", F.when(F.col("kind") == 1, F.struct("t", "ev"))).alias("head"))
    later = Window.partitionBy("k").orderBy(F.col("span").desc()).rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(F.col("k").alias("sk"), F.col("span").alias("s"), F.last("head", ignorenulls=True).over(later).alias("carry"))
    u = u.withColumn("j", F.last("ev", ignorenulls=True).over(w)).where("kind = 0")
    u = u.join(spans, F.col("k").eqNullSafe(F.col("sk")) & F.col("span").eqNullSafe(F.col("s")), "left")
    return u.select(F.col("src").cast("long").alias("seq"), F.coalesce("j", "carry").alias("j"))


def throttle(events: DataFrame, key: str, interval_seconds: int, ts: str = "ts", seq: str = "seq") -> DataFrame:
    """Greedy throttle: per key, accept an event when at least ``interval`` has passed
    since the last *accepted* one (the first event is always accepted).

    The accepted events form the chain first → next → next… where next(e) is the
    first event at or after ts(e) + interval. The chain is walked with pointer
    doubling: jump tables J_{i+1} = J_i ∘ J_i (one equi-join on the unique ``seq``
    per level, checkpointed), then the chain is expanded from the first events
    level by level. Work is O(n log n) and no key is ever collected; a hot key
    spreads over the join's partitions. Returns the accepted rows of ``events``."""
    spark = events.sparkSession
    ensure_checkpoint_dir(spark)
    e = events.select(F.col(key).alias("k"), F.col(ts).alias("ts"), F.col(seq).cast("long").alias("seq"))
    jumps = [cut_lineage(_next_allowed(e, interval_seconds))]
    while not jumps[-1].where(F.col("j").isNotNull()).isEmpty():
        a, b = jumps[-1].alias("a"), jumps[-1].select(F.col("seq").alias("bs"), F.col("j").alias("bj"))
        nxt = a.join(b, F.col("a.j") == F.col("bs"), "left").select(F.col("a.seq").alias("seq"), F.col("bj").alias("j"))
        jumps.append(cut_lineage(nxt.where(F.col("j").isNotNull())))
    jumps = jumps[:-1] if len(jumps) > 1 else jumps
    firsts = e.groupBy("k").agg(F.min_by("seq", F.struct("ts", "seq")).alias("seq")).select("seq")
    acc = cut_lineage(firsts)
    for j in reversed(jumps):
        step = acc.join(j, "seq").where(F.col("j").isNotNull()).select(F.col("j").alias("seq"))
        acc = cut_lineage(acc.unionByName(step).distinct())
    return events.join(acc.withColumnRenamed("seq", "_acc"), F.col(seq).cast("long") == F.col("_acc"), "left_semi")
