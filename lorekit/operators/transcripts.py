"""Transcripts → turns → per-session context windows under a size budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekit.functions.text import py_strip
from lorekit.session import path_exists

# ── Fixed values ──────────────────────────────────────────────────────
MAX_TURNS = 30
MAX_CONTEXT_CHARS = 15_000
MIN_TURNS_END = 1
MIN_TURNS_COMPACT = 5
ROLES = ("user", "assistant")
LONE_BACKSLASH = r'(?<!\\)\\(?!["\\])'


def repair_json(raw) -> F.Column:
    """Parse JSON; on failure double every lone backslash (not before ``"`` or ``\\``) and retry."""
    c = F.col(raw) if isinstance(raw, str) else raw
    return F.coalesce(F.try_parse_json(c), F.try_parse_json(F.regexp_replace(c, LONE_BACKSLASH, r"\\\\")))


def scan_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """JSONL transcripts, one file per session: (session_id, seq, line), no rows where the path is missing.

    A file is read in byte ranges, so a large one is many tasks. A line's ``seq`` is its number within its range, in
    the order of the task that reads it, plus the line counts of the file's earlier ranges (a prefix sum over one row
    a range). Both scans cut and pack the same files alike; a range that does not find its count is an error."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], "session_id string, seq int, line string")
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_block_start").alias("start"),
        F.spark_partition_id().alias("task"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at"), F.col("value").alias("line"))
    ranges = lines.groupBy("file", "start", "task").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.select("file", "start", "task", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    seq = F.coalesce(F.col("shift"), F.raise_error(F.lit("a transcript changed while it was read")).cast("long")) + F.col("at")
    name = F.url_decode(F.replace(F.col("name"), F.lit("+"), F.lit("%2B")))       # Spark gives it as part of a URI
    return lines.join(ranges, ["file", "start", "task"], "left").select(
        F.regexp_replace(name, r"\.jsonl$", "").alias("session_id"), seq.cast("int").alias("seq"), "line")


def _is(kind: str, v) -> F.Column:
    return F.schema_of_variant(v).startswith(kind)


def flatten_turns(lines: DataFrame) -> DataFrame:
    """(session_id, seq, role, text) from raw transcript lines.

    Blank and undecodable lines are skipped. ``message`` that is an object gives
    role/content; a ``message`` that exists but is not an object falls back to the
    top-level role/content; a record without ``message`` is dropped. List content
    joins ``text`` blocks and bare strings with LF. Only user/assistant turns with
    non-blank text are kept; text is stripped. Records the reference would crash on
    (non-object lines, ``text: null`` blocks) are skipped row by row."""
    x = lines.where(py_strip("line") != "").select(
        "session_id", "seq", F.try_parse_json(py_strip("line")).alias("v"))
    x = x.where(F.col("v").isNotNull() & _is("OBJECT", F.col("v")))
    msg = F.try_variant_get("v", "$.message", "variant")
    has_msg = msg.isNotNull()
    msg_obj = msg.isNotNull() & _is("OBJECT", msg)
    src = F.when(msg_obj, msg).otherwise(F.col("v"))
    x = x.where(has_msg).select("session_id", "seq", src.alias("m"))
    role = F.try_variant_get("m", "$.role", "string")
    content = F.try_variant_get("m", "$.content", "variant")
    x = x.select("session_id", "seq",
                 F.when(F.try_variant_get("m", "$.role", "variant").isNotNull()
                        & _is("STRING", F.try_variant_get("m", "$.role", "variant")), role).alias("role"),
                 content.alias("c"))
    blocks = F.try_variant_get("c", "$", "array<variant>")

    def block_text(b):
        is_text_obj = _is("OBJECT", b) & (F.try_variant_get(b, "$.type", "string") == "text")
        txt = F.try_variant_get(b, "$.text", "variant")
        return (F.when(is_text_obj, F.when(txt.isNull(), F.lit(""))
                       .when(_is("STRING", txt), F.try_variant_get(b, "$.text", "string")))
                .when(_is("STRING", b), F.try_variant_get(b, "$", "string")))

    def block_ok(b):
        is_text_obj = _is("OBJECT", b) & (F.try_variant_get(b, "$.type", "string") == "text")
        txt = F.try_variant_get(b, "$.text", "variant")
        return ~(is_text_obj & txt.isNotNull() & ~_is("STRING", txt))

    is_list = F.col("c").isNotNull() & _is("ARRAY", F.col("c"))
    is_str = F.col("c").isNotNull() & _is("STRING", F.col("c"))
    joined = F.array_join(F.filter(F.transform(blocks, block_text), lambda t: t.isNotNull()), "\n")
    text = F.when(is_list, joined).when(is_str, F.try_variant_get("c", "$", "string"))
    ok = F.when(is_list, F.forall(blocks, block_ok)).otherwise(F.lit(True))
    x = x.where(F.col("role").isin(*ROLES) & ok).select("session_id", "seq", "role", py_strip(text).alias("text"))
    return x.where(F.col("text").isNotNull() & (F.col("text") != ""))


def clean_turns(turns: DataFrame) -> DataFrame:
    """user/assistant turns with non-blank text, text stripped."""
    t = turns.where(F.col("role").isin(*ROLES)).withColumn("text", py_strip("text"))
    return t.where(F.col("text") != "")


def last_turns(turns: DataFrame, n: int = MAX_TURNS) -> DataFrame:
    """The last ``n`` turns of each session (Spark plans a per-partition group limit)."""
    w = Window.partitionBy("session_id").orderBy(F.col("seq").desc())
    return (clean_turns(turns).withColumn("rk", F.row_number().over(w))
            .where(F.col("rk") <= n).drop("rk"))


def session_context(turns: DataFrame, n: int = MAX_TURNS, budget: int = MAX_CONTEXT_CHARS) -> DataFrame:
    """(session_id, n_turns, context): ``**User:** text`` blocks of the last ``n`` turns
    joined by LF; over budget → keep the tail, then cut up to the first ``\\n**``
    found after position 0. The collect is per session and bounded by ``n``."""
    t = last_turns(turns, n)
    label = F.when(F.col("role") == "user", "User").otherwise("Assistant")
    t = t.select("session_id", "seq", F.concat(F.lit("**"), label, F.lit(":** "), F.col("text"), F.lit("\n")).alias("blk"))
    g = t.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "blk"))), lambda s: s["blk"]), "\n")
        .alias("full"))
    tail = F.expr(f"right(full, {budget})")
    b = F.locate("\n**", tail)
    cut = F.when(b > 1, F.substring(tail, b + 1, 1 << 30)).otherwise(tail)
    ctx = F.when(F.length("full") > budget, cut).otherwise(F.col("full"))
    return g.select("session_id", F.col("n_turns").cast("bigint").alias("n_turns"), ctx.alias("context"))


def gate_sessions(contexts: DataFrame, min_turns: int = MIN_TURNS_END) -> DataFrame:
    """Sessions worth flushing: non-blank context and at least ``min_turns`` recent turns."""
    return contexts.where((py_strip("context") != "") & (F.col("n_turns") >= min_turns))
