"""Project scoping: alias resolution, article filters, index-row scope, project
identity and registration. All joins are equi-joins on lower-cased aliases; the
registry side is small and AQE turns those joins into broadcasts at run time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekit.functions.text import basename, capitalize_first, sha_hex, strip_credentials

# ── Fixed values ──────────────────────────────────────────────────────
SHARED_VALUES = ("shared", "all")
STUB_NOTE = "Auto-registered on first detection — edit canonical/aliases/notes to customize."


def registry_names(registry: DataFrame) -> DataFrame:
    """(ord, id, alias_lc): lower-cased canonical, name and aliases of each entry, '' dropped."""
    names = F.concat(F.array(F.coalesce("canonical", F.lit(""))), F.array(F.coalesce("name", F.lit(""))),
                     F.coalesce("aliases", F.array().cast("array<string>")))
    e = registry.select("ord", "id", F.explode(names).alias("a"))
    return e.select("ord", "id", F.lower("a").alias("alias_lc")).where("alias_lc <> ''").distinct()


def resolve_aliases(idents: DataFrame, registry: DataFrame, col: str = "ident") -> DataFrame:
    """(ident, alias_lc): the whole alias set of the first registry entry whose
    names contain the identifier (case-insensitive), plus the identifier itself;
    an unknown identifier resolves to itself alone."""
    names = registry_names(registry)
    i = idents.select(F.col(col).alias("ident")).distinct().withColumn("ident_lc", F.lower("ident"))
    first = (i.join(names, i["ident_lc"] == names["alias_lc"])
             .groupBy("ident", "ident_lc").agg(F.min("ord").alias("ord")))
    members = first.join(names.select("ord", "alias_lc"), "ord").select("ident", "alias_lc")
    itself = i.select("ident", F.col("ident_lc").alias("alias_lc"))
    return members.unionByName(itself).distinct()


def alias_set(aliases: DataFrame) -> F.Column:
    """The alias set of one project as a scalar subquery (bounded by one registry entry)."""
    return aliases.agg(F.collect_set(F.col("alias_lc"))).scalar()


def filter_articles_by_project(articles: DataFrame, aliases: DataFrame) -> DataFrame:
    """Articles visible to a project given its alias set (alias_lc rows): field
    missing, list empty, ``shared``/``all`` present, or any value in the set.
    A list holding only ``""`` is not empty here."""
    a = articles.select("slug", "kind", "projects")
    low = F.transform("projects", F.lower)
    keep = (F.col("projects").isNull() | (F.size("projects") == 0)
            | F.exists(low, lambda p: p.isin(*SHARED_VALUES)) | F.arrays_overlap(low, alias_set(aliases)))
    return a.where(keep).select("slug", "kind")


def classify_scope(index_rows: DataFrame, articles: DataFrame, aliases: DataFrame | None) -> DataFrame:
    """(slug, raw, scope) of each index row for one current project: the row's first
    link names an article; missing article or field → shared; no values left after
    dropping '' or shared/all among them → shared; overlap with the alias set →
    current; else other. Without a current project every row is shared."""
    link = F.regexp_extract("raw", r"\[\[([^\]]+)\]\]", 1)
    keep = [c for c in index_rows.columns if c not in ("raw", "slug")]
    rows = index_rows.select(*keep, "raw", F.substring_index(link, "|", 1).alias("slug"))
    if aliases is None:
        return rows.select(*keep, "slug", "raw", F.lit("shared").alias("scope"))
    j = rows.join(articles.select("slug", "projects"), "slug", "left")
    vals = F.filter(F.transform(F.coalesce("projects", F.array().cast("array<string>")), F.lower),
                    lambda v: v != "")
    is_shared = (F.col("projects").isNull() | (F.size(vals) == 0) | F.exists(vals, lambda v: v.isin(*SHARED_VALUES)))
    scope = (F.when(is_shared, "shared").when(F.arrays_overlap(vals, alias_set(aliases)), "current")
             .otherwise("other"))
    return j.select(*keep, "slug", "raw", scope.alias("scope"))


def stamp_project(sessions: DataFrame, registry: DataFrame) -> DataFrame:
    """(session_id, id, name, canonical): id = sha256 of the credential-free remote,
    else of the root, first 12 hex; canonical from the registry entry, else its
    name, else the root's base name; no root → shared."""
    remote = strip_credentials("remote")
    pid = F.when(F.col("root").isNull(), F.lit("shared")).otherwise(
        F.when(F.col("remote").isNotNull(), sha_hex(remote, 12)).otherwise(sha_hex("root", 12)))
    s = sessions.select("session_id", "root", F.when(F.col("remote").isNotNull(), remote).alias("remote"),
                        pid.alias("id"), F.when(F.col("root").isNull(), F.lit("shared"))
                        .otherwise(basename("root")).alias("name"))
    r = registry.select("id", F.col("canonical").alias("r_canonical"), F.col("name").alias("r_name"))
    j = s.join(r, "id", "left")
    canonical = (F.when(F.col("root").isNull(), F.lit("Shared"))
                 .otherwise(F.coalesce(F.nullif("r_canonical", F.lit("")), F.nullif("r_name", F.lit("")), F.col("name"))))
    return j.select("session_id", "id", "name", canonical.alias("canonical"), "root", "remote")


def register_projects(registry: DataFrame, detected: DataFrame, as_of_date: str) -> DataFrame:
    """Insert-if-absent: one stub per new id (not null, not shared); existing entries
    are never changed; concurrent detections of one id collapse deterministically.

    Stubs follow the existing entries in the order of their ids, each with its own
    ``ord``: a rank within the ids of one two-character prefix plus the number of
    stubs with a smaller prefix (one row a prefix, so no window holds all stubs)."""
    new = (detected.where(F.col("id").isNotNull() & (F.col("id") != "shared"))
           .join(registry.select("id"), "id", "left_anti")
           .groupBy("id").agg(F.min_by(F.struct("name", "root", "remote"), "session_id").alias("s")))
    name = F.coalesce(F.col("s.name"), F.lit("unknown"))
    max_ord = F.coalesce(registry.agg(F.max("ord")).scalar(), F.lit(-1))
    new = new.withColumn("prefix", F.substring("id", 1, 2))
    before = new.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("prefix").alias("p"), F.coalesce(F.sum("n").over(Window.orderBy("prefix").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    new = new.withColumn("rank", F.row_number().over(Window.partitionBy("prefix").orderBy("id"))).join(
        before, F.col("prefix") == F.col("p"))
    stubs = new.select(
        (max_ord + F.col("before") + F.col("rank")).cast("int").alias("ord"),
        "id", name.alias("name"), capitalize_first(name).alias("canonical"),
        F.array(F.lower(name)).alias("aliases"), F.col("s.root").alias("root"), F.col("s.remote").alias("remote"))
    out = registry.select("ord", "id", "name", "canonical", "aliases", "root", "remote").withColumn(
        "auto_registered", F.lit(None).cast("string")).withColumn("notes", F.lit(None).cast("string"))
    stubs = stubs.withColumn("auto_registered", F.lit(as_of_date)).withColumn("notes", F.lit(STUB_NOTE))
    return out.unionByName(stubs)
