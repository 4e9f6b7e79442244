"""Structural health checks over a vault: each check is a join/aggregate job that
returns issue rows (severity, check, file, detail)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


# ── Fixed values: check names, severities and messages of the reference ──
SPARSE_MIN_WORDS = 200
HUB_MIN_INBOUND = 4
MSG_BROKEN_DAILY = "Daily source [[{}]] does not exist"
MSG_BROKEN_LINK = "Wikilink [[{}]] points to a non-existent article"
MSG_ORPHAN_PAGE = "No other article links to this one"
MSG_ORPHAN_SOURCE = "Daily log has not been compiled into knowledge yet"
MSG_STALE = "Source {} changed since last compile"
MSG_BACKLINK = "Target linked from [[{}]] but does not link back"
MSG_SPARSE = "Body has only {} words (threshold {})"
MSG_PROJECTS_MISSING = "Missing `projects:` frontmatter — treated as unscoped"
MSG_UNKNOWN_ALIAS = "Unknown project alias(es): [{}]"
CHECK_ORDER = ["broken_link", "orphan_page", "orphan_source", "stale_article", "missing_backlink",
               "sparse_article", "projects_missing", "unknown_project_alias"]
SEVERITY_ORDER = ["error", "warning", "suggestion"]
ISSUE_COLS = ["severity", "check", "file", "detail", "pos"]


def _fmt(template: str, *cols) -> F.Column:
    parts = template.split("{}")
    out = [F.lit(parts[0])]
    for c, p in zip(cols, parts[1:]):
        out += [c if not isinstance(c, (int, str)) else F.lit(str(c)), F.lit(p)]
    return F.concat(*out)


def _issues(df: DataFrame, severity: str, check: str, file, detail, pos=None) -> DataFrame:
    return df.select(F.lit(severity).alias("severity"), F.lit(check).alias("check"),
                     file.alias("file"), detail.alias("detail"),
                     (pos if pos is not None else F.lit(0)).cast("int").alias("pos"))


def lint_broken_links(links: DataFrame, knowledge_slugs: DataFrame, daily_names: DataFrame) -> DataFrame:
    """Per occurrence: a ``daily/…`` target must name an existing daily file exactly
    (``.md`` included); any other target must exist as ``<target>.md`` under knowledge."""
    daily = links.where("is_daily").withColumn("dname", F.expr("substr(target, 7)"))
    missing_daily = daily.join(daily_names.select(F.col("name").alias("dname")), "dname", "left_anti")
    other = links.where(~F.col("is_daily"))
    missing = other.join(knowledge_slugs.select(F.col("slug").alias("target")), "target", "left_anti")
    a = _issues(missing_daily, "error", "broken_link", F.concat("src", F.lit(".md")),
                _fmt(MSG_BROKEN_DAILY, F.col("target")), F.col("pos"))
    b = _issues(missing, "error", "broken_link", F.concat("src", F.lit(".md")),
                _fmt(MSG_BROKEN_LINK, F.col("target")), F.col("pos"))
    return a.unionByName(b)


def lint_orphan_pages(articles: DataFrame, links: DataFrame) -> DataFrame:
    """Articles no article links to (self-links count; the index does not)."""
    targets = links.select(F.col("target").alias("slug")).distinct()
    o = articles.select("slug").join(targets, "slug", "left_anti")
    return _issues(o, "warning", "orphan_page", F.concat("slug", F.lit(".md")), F.lit(MSG_ORPHAN_PAGE))


def lint_orphan_sources(dailies: DataFrame, state: DataFrame) -> DataFrame:
    """Daily logs with no compile-state record."""
    o = dailies.select("name").join(state.select("name"), "name", "left_anti")
    return _issues(o, "suggestion", "orphan_source", F.concat(F.lit("daily/"), "name"), F.lit(MSG_ORPHAN_SOURCE))


def lint_stale_articles(frontmatter: DataFrame, dailies: DataFrame, state: DataFrame) -> DataFrame:
    """First daily source (in source order) that exists, has a recorded hash, and
    whose current hash differs: at most one issue per article."""
    src = (frontmatter.where(F.col("key") == "sources")
           .select("slug", F.posexplode("vals").alias("k", "source"))
           .where(F.col("source").startswith("daily/")))
    dname = F.concat(F.regexp_replace(F.expr("substr(source, 7)"), r"\.md$", ""), F.lit(".md"))
    src = src.withColumn("name", dname)
    cur = dailies.select("name", F.col("sha16").alias("current"))
    st = state.select("name", F.col("hash").alias("recorded"))
    j = (src.join(cur, "name").join(st, "name")
         .where(F.col("recorded").isNotNull() & (F.col("recorded") != "") & (F.col("recorded") != F.col("current"))))
    first = j.groupBy("slug").agg(F.min_by("source", "k").alias("source"))
    return _issues(first, "warning", "stale_article", F.concat("slug", F.lit(".md")),
                   _fmt(MSG_STALE, F.col("source")))


def lint_missing_backlinks(articles: DataFrame, links: DataFrame) -> DataFrame:
    """Distinct A→B where B is an article (not daily) and B has no link to A; reported on B."""
    e = links.where(~F.col("is_daily")).select("src", "target").distinct()
    e = e.join(articles.select(F.col("slug").alias("target")), "target", "left_semi")
    back = links.select(F.col("target").alias("src"), F.col("src").alias("target")).distinct()
    m = e.join(back, ["src", "target"], "left_anti")
    return _issues(m, "suggestion", "missing_backlink", F.concat("target", F.lit(".md")),
                   _fmt(MSG_BACKLINK, F.col("src")))


def lint_sparse_articles(articles: DataFrame, min_words: int = SPARSE_MIN_WORDS) -> DataFrame:
    s = articles.where(F.col("n_words") < min_words)
    return _issues(s, "suggestion", "sparse_article", F.concat("slug", F.lit(".md")),
                   _fmt(MSG_SPARSE, F.col("n_words").cast("string"), str(min_words)))


def lint_projects_missing(articles: DataFrame) -> DataFrame:
    s = articles.where(F.col("projects").isNull())
    return _issues(s, "warning", "projects_missing", F.concat("slug", F.lit(".md")), F.lit(MSG_PROJECTS_MISSING))


def known_aliases(registry: DataFrame) -> DataFrame:
    """Lower-cased canonical, name and aliases of every entry, plus shared/all."""
    names = F.concat(
        F.when(F.col("canonical").isNotNull() & (F.col("canonical") != ""), F.array("canonical"))
        .otherwise(F.array().cast("array<string>")),
        F.when(F.col("name").isNotNull() & (F.col("name") != ""), F.array("name"))
        .otherwise(F.array().cast("array<string>")),
        F.coalesce("aliases", F.array().cast("array<string>")))
    k = registry.select(F.explode(names).alias("a")).select(F.lower("a").alias("alias_lc"))
    fixed = registry.sparkSession.createDataFrame([("shared",), ("all",)], "alias_lc string")
    return k.unionByName(fixed).distinct()


def lint_unknown_aliases(articles: DataFrame, registry: DataFrame) -> DataFrame:
    """Project values unknown to the registry; the detail lists them in order."""
    p = (articles.where(F.size("projects") > 0)
         .select("slug", F.posexplode("projects").alias("k", "p")))
    u = p.join(known_aliases(registry), F.lower(p["p"]) == F.col("alias_lc"), "left_anti")
    g = u.groupBy("slug").agg(F.array_sort(F.collect_list(F.struct("k", "p"))).alias("u"))
    listing = F.array_join(F.transform("u", lambda s: F.concat(F.lit("'"), s["p"], F.lit("'"))), ", ")
    return _issues(g, "suggestion", "unknown_project_alias", F.concat("slug", F.lit(".md")),
                   _fmt(MSG_UNKNOWN_ALIAS, listing))


def lint_all(vault: dict) -> DataFrame:
    """The 8 structural checks in the reference's order; duplicates kept."""
    a, ln = vault["articles"], vault["links"]
    parts = [
        lint_broken_links(ln, vault["knowledge_slugs"], vault["dailies"]),
        lint_orphan_pages(a, ln),
        lint_orphan_sources(vault["dailies"], vault["state"]),
        lint_stale_articles(vault["frontmatter"], vault["dailies"], vault["state"]),
        lint_missing_backlinks(a, ln),
        lint_sparse_articles(a),
        lint_projects_missing(a),
        lint_unknown_aliases(a, vault["registry"]),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def lint_summary(issues: DataFrame) -> DataFrame:
    """Issue counts by severity and check, with per-severity and grand totals."""
    return issues.rollup("severity", "check").agg(F.count(F.lit(1)).alias("n"))


def _order_col(c: str, values: list[str]) -> F.Column:
    return F.array_position(F.array(*[F.lit(v) for v in values]), F.col(c)).cast("int")


def lint_report(issues: DataFrame, as_of: str) -> DataFrame:
    """The markdown report as rows (block, sev_ord, check_ord, file, pos, line), in
    report order when sorted by (sev_ord, block, check_ord, file, pos): title and
    totals (sev_ord 0), then per non-empty severity its heading and a blank line
    (block 1), the issue lines (block 2) and a blank line (block 3). A writer sorts
    and concatenates; a large vault never becomes one string on one task."""
    spark = issues.sparkSession
    i = issues.select("*", _order_col("severity", SEVERITY_ORDER).alias("sev_ord"),
                      _order_col("check", CHECK_ORDER).alias("check_ord"))
    items = i.select(
        F.lit(2).alias("block"), "sev_ord", "check_ord", "file", "pos",
        F.concat(F.lit("- **"), F.col("check"), F.lit("** · `"), F.col("file"), F.lit("` — "),
                 F.col("detail")).alias("line"))
    counts = issues.agg(
        F.count(F.when(F.col("severity") == "error", 1)).alias("e"),
        F.count(F.when(F.col("severity") == "warning", 1)).alias("w"),
        F.count(F.when(F.col("severity") == "suggestion", 1)).alias("s"),
        F.count(F.lit(1)).alias("t"))
    totals = F.concat(F.lit("**"), F.col("e").cast("string"), F.lit(" errors, "), F.col("w").cast("string"),
                      F.lit(" warnings, "), F.col("s").cast("string"), F.lit(" suggestions.**"))
    head_lines = F.when(F.col("t") == 0, F.array(
        F.lit("# Lint Report"), F.lit(""), F.lit("**0 issues.** Knowledge base is healthy."))).otherwise(
        F.array(F.lit(f"# Lint Report — {as_of}"), F.lit(""), totals, F.lit("")))
    head = counts.select(F.posexplode(head_lines).alias("pos", "line")).select(
        F.lit(0).alias("block"), F.lit(0).alias("sev_ord"), F.lit(0).alias("check_ord"),
        F.lit("").alias("file"), F.col("pos").cast("int").alias("pos"), "line")
    labels = spark.createDataFrame([(1, "## Errors"), (2, "## Warnings"), (3, "## Suggestions")],
                                   "sev_ord int, label string")
    present = i.select("sev_ord").distinct().join(labels, "sev_ord")
    # per severity: heading and a blank line (block 1), the items (block 2), a closing blank line (block 3)
    sec = present.select("sev_ord", F.posexplode(F.array(F.col("label"), F.lit(""))).alias("pos", "line"))
    sec_head = sec.select(F.lit(1).alias("block"), "sev_ord", F.lit(0).alias("check_ord"), F.lit("").alias("file"),
                          F.col("pos").cast("int").alias("pos"), "line")
    trailer = present.select(F.lit(3).alias("block"), "sev_ord", F.lit(0).alias("check_ord"), F.lit("").alias("file"),
                             F.lit(0).alias("pos"), F.lit("").alias("line"))
    return head.unionByName(sec_head).unionByName(items).unionByName(trailer)


def inbound_links(articles: DataFrame, links: DataFrame) -> DataFrame:
    """Articles containing the literal ``[[target]]`` (no label), the target itself excluded."""
    e = links.where((F.col("raw") == F.col("target")) & (F.col("src") != F.col("target"))).select("src", "target").distinct()
    return e.groupBy("target").agg(F.count(F.lit(1)).alias("n_inbound"))


def hub_concepts(articles: DataFrame, links: DataFrame, k: int = HUB_MIN_INBOUND) -> DataFrame:
    """Articles linked from at least ``k`` other articles."""
    e = (links.where(~F.col("is_daily") & (F.col("src") != F.col("target")))
         .select("src", F.col("target").alias("slug")).distinct()
         .join(articles.select("slug"), "slug", "left_semi"))
    return e.groupBy("slug").agg(F.count(F.lit(1)).alias("n_inbound")).where(F.col("n_inbound") >= k)


def wanted_concepts(links: DataFrame, knowledge_slugs: DataFrame) -> DataFrame:
    """Targets mentioned but not created: occurrences and distinct linking articles."""
    m = (links.where(~F.col("is_daily"))
         .join(knowledge_slugs.select(F.col("slug").alias("target")), "target", "left_anti"))
    return m.groupBy("target").agg(F.count(F.lit(1)).alias("n_mentions"),
                                   F.countDistinct("src").alias("n_articles"))


# ── Model-judged contradictions (the response is an input column) ─────

CONTRADICTION_DEFAULTS = ("?", "conflicting claim")


def parse_issue_json(responses: DataFrame, text_col: str = "text") -> DataFrame:
    """Issues from a model response: the text from the first ``[`` to the last
    ``]`` parsed as JSON; non-object items are dropped; missing file/detail become
    ``?`` / ``conflicting claim``. Severity warning, check ``contradiction``."""
    t = F.col(text_col)
    start = F.locate("[", t)
    end = F.length(t) - F.locate("]", F.reverse(t)) + 1
    body = F.when((start > 0) & (F.locate("]", F.reverse(t)) > 0) & (end >= start),
                  F.expr(f"substring({text_col}, locate('[', {text_col}), "
                         f"length({text_col}) - locate(']', reverse({text_col})) + 2 - locate('[', {text_col}))"))
    items = F.try_variant_get(F.try_parse_json(body), "$", "array<variant>")
    x = responses.select(F.posexplode(F.filter(items, lambda v: F.schema_of_variant(v).startswith("OBJECT"))).alias("pos", "v"))
    f, d = CONTRADICTION_DEFAULTS
    return x.select(F.lit("warning").alias("severity"), F.lit("contradiction").alias("check"),
                    F.coalesce(F.try_variant_get("v", "$.file", "string"), F.lit(f)).alias("file"),
                    F.coalesce(F.try_variant_get("v", "$.detail", "string"), F.lit(d)).alias("detail"),
                    F.col("pos").cast("int").alias("pos"))
