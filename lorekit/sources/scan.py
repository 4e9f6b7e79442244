"""File sources and sinks of a knowledge base on disk (or object storage).

Markdown files are read with ``binaryFile`` so the content hash is taken over
the raw bytes while the text is decoded with text-mode newlines; JSON and JSONL
records are parsed with explicit schemas or VARIANT."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekit.functions.text import normalize_newlines, py_lines
from lorekit.session import list_paths, path_exists

LAYERS = ("daily", "knowledge", "knowledge/concepts", "knowledge/connections", "knowledge/qa", "knowledge/instincts", "wiki", "raw")

OBSERVATION_SCHEMA = ("ts string, ts_ms long, session_id string, project string, event string, tool string, "
                      "input_summary string, tool_call_num int, success boolean, error string")
REGISTRY_ENTRY = ("struct<id: string, name: string, canonical: string, aliases: array<string>, root: string, "
                  "remote: string, auto_registered: string, notes: string>")
FINDING = "struct<file: string, line: int, title: string, category: string, severity: string>"
BUILD_LOG_HEAD = r"^## \[([^\]]+)\] (\S+) \| (.*)$"


def scan_vault(spark: SparkSession, root: str, layers=LAYERS) -> DataFrame:
    """Every ``.md`` file directly inside each layer folder:
    (path, layer, kind, slug, name, content, sha16). ``sha16`` is over the raw
    bytes; ``content`` is decoded UTF-8 with CRLF/CR turned into LF. The files of
    ``knowledge`` itself are the index and the build log (slugs ``index`` and
    ``log``, kind ``root``). A missing or empty layer gives no rows."""
    root = root.rstrip("/")
    out = spark.createDataFrame([], "path string, layer string, kind string, slug string, name string, content string, sha16 string")
    for layer in layers:
        if not path_exists(spark, f"{root}/{layer}"):
            continue
        df = (spark.read.format("binaryFile").option("pathGlobFilter", "*.md")
              .option("recursiveFileLookup", "false").load(f"{root}/{layer}"))
        name = F.element_at(F.split("path", "/"), -1)
        kind = F.lit("root" if layer == "knowledge" else layer.split("/")[-1])
        rel = name if layer == "knowledge" else F.concat(F.lit(layer.split("/", 1)[-1] + "/") if layer.startswith("knowledge/") else F.lit(layer + "/"), name)
        df = df.select(
            "path", F.lit(layer).alias("layer"), kind.alias("kind"),
            F.regexp_replace(rel, r"\.md$", "").alias("slug"), name.alias("name"),
            normalize_newlines(F.decode("content", "UTF-8")).alias("content"),
            F.substring(F.sha2("content", 256), 1, 16).alias("sha16"))
        out = out.unionByName(df)
    return out


def _whole_text(spark: SparkSession, path: str) -> DataFrame:
    """(value) of each file; no rows where there is none."""
    return spark.read.text(path, wholetext=True) if path_exists(spark, path) else spark.createDataFrame([], "value string")


def scan_observations(spark: SparkSession, path: str) -> DataFrame:
    """Observation JSONL: bad JSON lines and unparsable ``ts`` are dropped; a missing path gives no rows."""
    schema = OBSERVATION_SCHEMA + ", _corrupt string"
    raw = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt").option("mode", "PERMISSIVE").json(path) if path_exists(
        spark, path) else spark.createDataFrame([], schema)
    ts = F.try_to_timestamp(F.regexp_replace("ts", "Z$", "+00:00"), F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"))
    return (raw.where(F.col("_corrupt").isNull()).withColumn("ts", ts).where(F.col("ts").isNotNull())
            .drop("_corrupt"))


def scan_registry(spark: SparkSession, path: str) -> DataFrame:
    """``parse_registry`` of a file; a missing one gives no rows."""
    return parse_registry(_whole_text(spark, path))


def parse_registry(texts: DataFrame) -> DataFrame:
    """The registry JSON object keyed by id (column ``value``), as rows in the order of the text (``ord``), with the
    other columns; a malformed text gives no rows."""
    rest = [c for c in texts.columns if c != "value"]
    m = F.from_json("value", f"map<string,{REGISTRY_ENTRY}>")
    e = texts.select(*rest, F.posexplode(F.map_entries(m)).alias("ord", "e"))
    return e.select(*rest, F.col("ord").cast("int").alias("ord"), F.coalesce("e.value.id", "e.key").alias("id"),
                    "e.value.name", "e.value.canonical", "e.value.aliases", "e.value.root", "e.value.remote",
                    "e.value.auto_registered", "e.value.notes")


def scan_compile_state(spark: SparkSession, path: str) -> DataFrame:
    """``parse_compile_state`` of a file; a missing one gives no rows."""
    return parse_compile_state(_whole_text(spark, path))


def parse_compile_state(texts: DataFrame) -> DataFrame:
    """``ingested`` records of compile states (column ``value``), with the other columns: (name, hash NULL when the record
    is not an object or has none, compiled_at)."""
    rest = [c for c in texts.columns if c != "value"]
    t = texts.select(*rest, F.try_parse_json("value").alias("v"))
    m = F.try_variant_get("v", "$.ingested", "map<string,variant>")
    e = t.select(*rest, F.explode(m).alias("name", "r"))
    is_obj = F.schema_of_variant("r").startswith("OBJECT")
    return e.select(*rest, "name", F.when(is_obj, F.try_variant_get("r", "$.hash", "string")).alias("hash"),
                    F.when(is_obj, F.try_variant_get("r", "$.compiled_at", "string")).alias("compiled_at"))


def scan_build_log(files: DataFrame) -> DataFrame:
    """Build-log entries ``## [ts] op | text`` with their ``- key: value`` detail lines:
    (name, pos, ts, op, description, details)."""
    lines = files.select("name", F.posexplode(py_lines("content")).alias("pos", "line"))
    head = F.col("line").rlike(BUILD_LOG_HEAD)
    from pyspark.sql import Window
    w = Window.partitionBy("name").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    x = lines.withColumn("entry", F.max(F.when(head, F.col("pos"))).over(w)).where(F.col("entry").isNotNull())
    heads = x.where(head).select("name", F.col("pos").alias("entry"),
                                 F.regexp_extract("line", BUILD_LOG_HEAD, 1).alias("ts"),
                                 F.regexp_extract("line", BUILD_LOG_HEAD, 2).alias("op"),
                                 F.regexp_extract("line", BUILD_LOG_HEAD, 3).alias("description"))
    det = (x.where(~head & F.col("line").startswith("- ")).groupBy("name", "entry")
           .agg(F.array_sort(F.collect_list(F.struct("pos", F.substring("line", 3, 1 << 30).alias("d")))).alias("ds")))
    return (heads.join(det, ["name", "entry"], "left")
            .select("name", F.col("entry").alias("pos"), F.to_timestamp("ts").alias("ts"), "op", "description",
                    F.coalesce(F.transform("ds", lambda s: s["d"]), F.array().cast("array<string>")).alias("details")))


def scan_findings(spark: SparkSession, path: str) -> DataFrame:
    """Security scan reports (one JSON document per file): one row per finding; a missing path gives no rows."""
    return parse_findings(_whole_text(spark, path).withColumn("report", F.input_file_name()))


def parse_findings(reports: DataFrame) -> DataFrame:
    """One row per finding of each report (report, value): (report, idx, file, line, title, category, severity)."""
    j = reports.select("report", F.from_json("value", f"struct<findings: array<{FINDING}>>").alias("j"))
    return j.select("report", F.posexplode("j.findings").alias("idx", "f")).select("report", "idx", "f.*")


def write_issues(issues: DataFrame, path: str, fmt: str = "json") -> None:
    """Issues as JSON lines or parquet; ``document`` writes one JSON document ``{"issues": [...], "count": n}`` and
    ``markdown`` takes ``lint_report`` rows, both in report order as text part files to be joined in name order."""
    if fmt == "json":
        issues.write.mode("overwrite").json(path)
    elif fmt == "document":
        issue_document(issues).orderBy("part", "check_ord", "file", "pos", "rest", "copy").select("line").write.mode("overwrite").text(path)
    elif fmt == "parquet":
        issues.write.mode("overwrite").parquet(path)
    elif fmt == "markdown":
        # a global sort writes range-ordered part files: concatenated in name order they are the
        # report, and no single task ever holds all of it
        (issues.orderBy("sev_ord", "block", "check_ord", "file", "pos").select("line")
         .write.mode("overwrite").text(path))
    else:
        raise ValueError(fmt)


def issue_document(issues: DataFrame) -> DataFrame:
    """The lines of ``{"issues": [...], "count": n}`` (part, check_ord, file, pos, rest, copy, line), in document order
    when sorted by all but the last: a head, one line an issue, a tail. Nothing is collected; the first issue, which
    alone has no comma before it, and the count are scalars."""
    from lorekit.operators.lint import CHECK_ORDER
    order = F.array_position(F.array(*[F.lit(c) for c in CHECK_ORDER]), F.col("check"))
    body = F.to_json(F.struct("severity", "check", "file", "detail"), {"ignoreNullFields": "false"})
    i = issues.select(F.coalesce(F.when(order > 0, order), F.lit(len(CHECK_ORDER) + 1)).alias("check_ord"), F.coalesce("file", F.lit("")).alias("file"),
                      F.coalesce("pos", F.lit(0)).alias("pos"), body.alias("rest"))
    i = i.groupBy("check_ord", "file", "pos", "rest").agg(F.count(F.lit(1)).alias("n"))
    key = F.struct("check_ord", "file", "pos", "rest")
    first, count = i.agg(F.min(key).alias("k")).scalar(), i.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    rows = i.select(F.lit(1).alias("part"), "check_ord", "file", "pos", "rest", F.explode(F.sequence(F.lit(1), "n")).alias("copy"))
    comma = F.when((key == first) & (F.col("copy") == 1), "").otherwise(",")
    rows = rows.withColumn("line", F.concat(comma, F.col("rest")))
    ends = issues.sparkSession.createDataFrame([(0,), (2,)], "part int").select(
        "part", F.lit(0).cast("long").alias("check_ord"), F.lit("").alias("file"), F.lit(0).alias("pos"), F.lit("").alias("rest"), F.lit(0).cast("long").alias("copy"),
        F.when(F.col("part") == 0, '{"issues": [').otherwise(F.concat(F.lit('], "count": '), count.cast("string"), F.lit("}"))).alias("line"))
    return rows.unionByName(ends)


def write_version(df: DataFrame, table_root: str, version: int) -> str:
    """Keyed rewrite without MERGE: the new full table goes to its own version
    directory; readers take the highest complete version."""
    path = f"{table_root.rstrip('/')}/v={version:08d}"
    df.write.mode("overwrite").parquet(path)
    return path


def read_version(spark: SparkSession, table_root: str, schema: str, below: int | None = None) -> DataFrame:
    """The highest complete version of a table (below a number, if given); no rows
    of ``schema`` where there is none."""
    root = table_root.rstrip("/")
    numbers = sorted(int(p.rsplit("/v=", 1)[1].split("/")[0]) for p in list_paths(spark, f"{root}/v=*/_SUCCESS"))
    numbers = [n for n in numbers if below is None or n < below]
    return spark.read.schema(schema).parquet(f"{root}/v={numbers[-1]:08d}") if numbers else spark.createDataFrame([], schema)


def upsert_by_key(current: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """New full table: current rows whose key is not in ``changes``, plus ``changes``."""
    return current.join(changes.select(*key), key, "left_anti").unionByName(changes, allowMissingColumns=True)
