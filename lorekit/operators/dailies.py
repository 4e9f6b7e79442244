"""Daily logs: per-project session counts, pending/due compile checks, rendering
and the latest-daily pointer of the digest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekit.functions.text import py_strip
from lorekit.operators.extract import extract_headers_scoped
from lorekit.operators.scope import registry_names
from lorekit.session import path_exists

# ── Fixed values ──────────────────────────────────────────────────────
COMPILE_AFTER_HOUR = 18
UNIVERSAL = ("shared", "all")


def scoped_headers(dailies: DataFrame, registry: DataFrame) -> DataFrame:
    """(name, pos, header, project): every ``### `` line with the project(s) it is
    scoped to. A tag shared by several registry entries yields one row per entry;
    an untagged header or a shared/all tag gets project NULL (it matches every
    project); a tag no entry knows keeps its own lower-cased text."""
    h = extract_headers_scoped(dailies).select(
        "name", "pos", py_strip(F.substring("line", 5, 1 << 30)).alias("header"),
        F.lower("header_project").alias("tag"))
    universal = h.where(F.col("tag").isNull() | F.col("tag").isin(*UNIVERSAL)).select(
        "name", "pos", "header", F.lit(None).cast("string").alias("project"))
    tagged = h.where(F.col("tag").isNotNull() & ~F.col("tag").isin(*UNIVERSAL))
    names = registry_names(registry).join(registry.select("ord", "canonical"), "ord")
    hit = tagged.join(names, tagged["tag"] == names["alias_lc"]).select("name", "pos", "header", "canonical")
    hit = hit.distinct().withColumnRenamed("canonical", "project")
    unknown = tagged.join(names, tagged["tag"] == names["alias_lc"], "left_anti").select(
        "name", "pos", "header", F.col("tag").alias("project"))
    return universal.unionByName(hit).unionByName(unknown)


def section_counts(scoped: DataFrame) -> DataFrame:
    """(name, project, n_sessions, last_header): per daily and project; project
    NULL holds the headers that count for every project."""
    return scoped.groupBy("name", "project").agg(
        F.count(F.lit(1)).alias("n_sessions"), F.max_by("header", "pos").alias("last_header"))


def daily_projects(sections: DataFrame) -> DataFrame:
    """Distinct sorted canonical projects of each daily (from tagged sections)."""
    return sections.groupBy("name").agg(F.array_sort(F.collect_set("project")).alias("projects"))


def pending_dailies(dailies: DataFrame, state: DataFrame, force: bool = False) -> DataFrame:
    """Dailies with no record, a record without a hash, or a hash that differs.
    ``sha16`` is the hash of the file's raw bytes, as ``scan_vault`` gives it."""
    d = dailies.select("name", F.col("sha16").alias("current"))
    if force:
        return d.select("name")
    j = d.join(state.select("name", F.col("hash").alias("recorded")), "name", "left")
    return j.where(~F.col("recorded").eqNullSafe(F.col("current"))).select("name")


def autocompile_due(checks: DataFrame, dailies: DataFrame, state: DataFrame, tz: str = "UTC",
                    after_hour: int = COMPILE_AFTER_HOUR) -> DataFrame:
    """For each check time (``at``): is today's daily due for compiling? Only from
    the configured local hour on, and only when that daily is pending."""
    local = F.from_utc_timestamp(F.col("at"), tz) if tz != "UTC" else F.col("at")
    c = checks.select("*", F.concat(F.date_format(local, "yyyy-MM-dd"), F.lit(".md")).alias("name"),
                      F.hour(local).alias("hour")).where(F.col("hour") >= after_hour)
    return c.join(pending_dailies(dailies, state), "name", "left_semi")


def render_daily(flushes: DataFrame, tz: str = "UTC", existing: DataFrame | None = None) -> DataFrame:
    """Daily files as rows (name, ts, text): a title row per date, then one
    ``### Session (HH:MM) — project`` block per flush in time order. A date whose
    file is in ``existing`` (name) has its title already."""
    local = F.from_utc_timestamp(F.col("ts"), tz) if tz != "UTC" else F.col("ts")
    f = flushes.select("*", local.alias("lts"))
    blocks = f.select(F.concat(F.date_format("lts", "yyyy-MM-dd"), F.lit(".md")).alias("name"), "ts",
                      F.concat(F.lit("\n### Session ("), F.date_format("lts", "HH:mm"), F.lit(") — "),
                               F.col("canonical"), F.lit("\n\n"), F.col("body"), F.lit("\n")).alias("text"))
    titles = f.groupBy(F.to_date("lts").alias("d")).agg(F.min("ts").alias("ts")).select(
        F.concat(F.date_format("d", "yyyy-MM-dd"), F.lit(".md")).alias("name"),
        F.lit(None).cast(flushes.schema["ts"].dataType).alias("ts"),
        F.concat(F.lit("# Daily Log: "), F.date_format("d", "dd.MM.yyyy"), F.lit("\n\n## Sessions\n")).alias("text"))
    if existing is not None:
        titles = titles.join(existing.select("name"), "name", "left_anti")
    return titles.unionByName(blocks)


def log_number(name) -> F.Column:
    """Which of its date's logs a daily is: 0 for ``<date>.md``, k for ``<date>-<k>.md``."""
    return F.coalesce(F.regexp_extract(name, r"^\d{4}-\d\d-\d\d-(\d+)\.md$", 1).try_cast("long"), F.lit(0).cast("long"))


def day_log(name) -> F.Column:
    """The name of a date's first log, for any of its logs."""
    return F.regexp_replace(name, r"^(\d{4}-\d\d-\d\d)-\d+\.md$", "$1.md")


def latest_daily_pointer(dailies: DataFrame, registry: DataFrame, as_of: str) -> DataFrame:
    """Per registry project: today's logs if there are any, else yesterday's. A date has one log or several that are
    numbered (see ``log_number``); the pointer names the first, counts the sessions scoped to the project in all of
    them and has the last such header."""
    today = F.to_date(F.lit(as_of))
    names = dailies.select("name", F.col("date")).where((F.col("date") == today) | (F.col("date") == F.date_sub(today, 1)))
    pick_name = names.agg(F.min_by("name", F.struct(F.datediff(today, "date"), log_number("name")))).scalar()
    pick_date = names.agg(F.max("date")).scalar()
    chosen = dailies.where(F.col("date") == pick_date)
    scoped = scoped_headers(chosen, registry).withColumn("pos", F.struct(log_number("name").alias("log"), "pos"))
    projects = registry.select("canonical").where(F.col("canonical") != "Shared").distinct()
    per = scoped.where(F.col("project").isNotNull()).groupBy("project").agg(
        F.count(F.lit(1)).alias("n"), F.max_by(F.struct("header", "pos"), "pos").alias("last"))
    universal = scoped.where(F.col("project").isNull())
    j = (projects.join(per, projects["canonical"] == per["project"], "left")
         .withColumn("n_u", universal.agg(F.count(F.lit(1))).scalar())
         .withColumn("last_u", universal.agg(F.max_by(F.struct("header", "pos"), "pos")).scalar())
         .withColumn("name", pick_name).withColumn("date", pick_date))
    n = F.coalesce("n", F.lit(0)) + F.coalesce("n_u", F.lit(0))
    last = F.when(F.col("last").isNull(), F.col("last_u.header")).when(F.col("last_u").isNull(), F.col("last.header")).otherwise(
        F.when(F.col("last.pos") > F.col("last_u.pos"), F.col("last.header")).otherwise(F.col("last_u.header")))
    label = F.when(F.col("date") == today, F.lit("today")).otherwise(F.lit("yesterday"))
    return j.where(F.col("name").isNotNull()).select(
        F.col("canonical").alias("project"), "name", label.alias("label"), n.cast("bigint").alias("n_sessions"),
        F.when(n > 0, last).alias("last_header"))


def write_daily(rows: DataFrame, path: str) -> None:
    """Append rendered daily rows, partitioned by daily name (the commit protocol
    replaces the reference's append-under-lock); a title that is there already is
    not written again."""
    spark = rows.sparkSession
    if path_exists(spark, f"{path.rstrip('/')}/name=*"):
        there = spark.read.schema(rows.schema).parquet(path).where("ts IS NULL").select("name").distinct()
        rows = rows.where("ts IS NOT NULL").unionByName(rows.where("ts IS NULL").join(there, "name", "left_anti").select(*rows.columns))
    rows.write.mode("append").partitionBy("name").parquet(path)
