"""Named queries: each takes (spark, sf_dir) and returns a DataFrame.

Every query reads the driver tables through the adapters, so its work grows
with them. Output columns are aliased to the names the oracle SQL uses.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekit.operators import lint
from lorekit.plans.vault import Vault

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def _issues(df: DataFrame) -> DataFrame:
    return df.select("severity", "check", "file", "detail")


# ── Links and lint ────────────────────────────────────────────────────

@query("extract_links")
def q_extract_links(spark, sf):
    v = Vault(spark, sf)
    return v["links"].select("src", F.col("pos").cast("bigint").alias("pos"), "raw", "target", "is_daily")


@query("lint_broken_links")
def q_lint_broken_links(spark, sf):
    v = Vault(spark, sf)
    return _issues(lint.lint_broken_links(v["links"], v["knowledge_slugs"], v["dailies"]))


def _list_cols(c: str, name: str | None = None):
    """Arrays leave a query as (joined text, size) so both engines hash them alike."""
    name = name or c
    return [F.array_join(F.col(c), " | ").alias(f"{name}_list"), F.size(c).cast("bigint").alias(f"n_{name}")]


@query("extract_frontmatter")
def q_extract_frontmatter(spark, sf):
    v = Vault(spark, sf)
    return v["frontmatter"].select("slug", "key", F.col("pos").cast("bigint").alias("pos"), "is_list",
                                   *_list_cols("vals"))


@query("extract_projects")
def q_extract_projects(spark, sf):
    v = Vault(spark, sf)
    a = v["articles"]
    return a.select("slug", F.col("projects").isNotNull().alias("has_field"),
                    F.array_join("projects", " | ").alias("projects_list"),
                    F.size("projects").cast("bigint").alias("n_projects"))


@query("extract_sources")
def q_extract_sources(spark, sf):
    from lorekit.operators.extract import extract_sources
    v = Vault(spark, sf)
    return extract_sources(v["articles"])


@query("lint_orphan_pages")
def q_lint_orphan_pages(spark, sf):
    v = Vault(spark, sf)
    return _issues(lint.lint_orphan_pages(v["articles"], v["links"]))


@query("lint_orphan_sources")
def q_lint_orphan_sources(spark, sf):
    v = Vault(spark, sf)
    return _issues(lint.lint_orphan_sources(v["dailies"], v["state"]))


@query("lint_stale_articles")
def q_lint_stale_articles(spark, sf):
    v = Vault(spark, sf)
    return _issues(lint.lint_stale_articles(v["frontmatter"], v["dailies"], v["state"]))


@query("lint_missing_backlinks")
def q_lint_missing_backlinks(spark, sf):
    v = Vault(spark, sf)
    return _issues(lint.lint_missing_backlinks(v["articles"], v["links"]))


@query("lint_sparse_articles")
def q_lint_sparse_articles(spark, sf):
    v = Vault(spark, sf)
    return _issues(lint.lint_sparse_articles(v["articles"]))


@query("lint_projects_missing")
def q_lint_projects_missing(spark, sf):
    v = Vault(spark, sf)
    return _issues(lint.lint_projects_missing(v["articles"]))


@query("lint_unknown_aliases")
def q_lint_unknown_aliases(spark, sf):
    v = Vault(spark, sf)
    return _issues(lint.lint_unknown_aliases(v["articles"], v["registry"]))


@query("lint_all")
def q_lint_all(spark, sf):
    return _issues(lint.lint_all(Vault(spark, sf)))


@query("lint_summary")
def q_lint_summary(spark, sf):
    return lint.lint_summary(lint.lint_all(Vault(spark, sf)))


LINT_AS_OF = "2024-02-01T00:00:00"


@query("lint_report")
def q_lint_report(spark, sf):
    return lint.lint_report(lint.lint_all(Vault(spark, sf)), LINT_AS_OF)


@query("inbound_links")
def q_inbound_links(spark, sf):
    v = Vault(spark, sf)
    return lint.inbound_links(v["articles"], v["links"])


@query("hub_concepts")
def q_hub_concepts(spark, sf):
    v = Vault(spark, sf)
    return lint.hub_concepts(v["articles"], v["links"])


@query("wanted_concepts")
def q_wanted_concepts(spark, sf):
    v = Vault(spark, sf)
    return lint.wanted_concepts(v["links"], v["knowledge_slugs"])


# ── Registry and scope ────────────────────────────────────────────────

SCOPE_PROJECT = "project-3"      # an alias, resolved through the registry
CURRENT_PROJECT = "Src3"
REGISTER_AS_OF = "2024-02-01"


def _idents(v: Vault) -> DataFrame:
    p = v["articles"].select(F.explode("projects").alias("ident"))
    t = v["sections"].select(F.col("tag").alias("ident"))
    return p.unionByName(t).distinct()


@query("extract_sections")
def q_extract_sections(spark, sf):
    v = Vault(spark, sf)
    return v["sections"].select("name", "header", "tag", "project", F.col("pos").cast("bigint").alias("pos"))


@query("resolve_aliases")
def q_resolve_aliases(spark, sf):
    from lorekit.operators.scope import resolve_aliases
    v = Vault(spark, sf)
    return resolve_aliases(_idents(v), v["registry"])


def _aliases_of(spark, v: Vault, ident: str) -> DataFrame:
    from lorekit.operators.scope import resolve_aliases
    return resolve_aliases(spark.createDataFrame([(ident,)], "ident string"), v["registry"])


@query("filter_articles_by_project")
def q_filter_articles_by_project(spark, sf):
    from lorekit.operators.scope import filter_articles_by_project
    v = Vault(spark, sf)
    return filter_articles_by_project(v["articles"], _aliases_of(spark, v, SCOPE_PROJECT))


@query("classify_scope")
def q_classify_scope(spark, sf):
    from lorekit.operators.scope import classify_scope
    v = Vault(spark, sf)
    return classify_scope(v["index_rows"], v["articles"], _aliases_of(spark, v, CURRENT_PROJECT)).select("slug", "scope")


@query("stamp_project")
def q_stamp_project(spark, sf):
    from lorekit.operators.scope import stamp_project
    v = Vault(spark, sf)
    return stamp_project(v["sessions"], v["registry"]).select("session_id", "id", "name", "canonical")


@query("register_projects")
def q_register_projects(spark, sf):
    from lorekit.operators.scope import register_projects, stamp_project
    v = Vault(spark, sf)
    r = register_projects(v["registry"], stamp_project(v["sessions"], v["registry"]), REGISTER_AS_OF)
    return r.select(F.col("ord").cast("bigint").alias("ord"), "id", "name", "canonical",
                    *_list_cols("aliases"), "root", "remote", "auto_registered", "notes")


# ── Transcripts ───────────────────────────────────────────────────────

CTX_TURNS, CTX_BUDGET = 4, 800


@query("last_turns")
def q_last_turns(spark, sf):
    from lorekit.operators.transcripts import last_turns
    return last_turns(Vault(spark, sf)["turns"], CTX_TURNS)


@query("session_context")
def q_session_context(spark, sf):
    from lorekit.operators.transcripts import session_context
    return session_context(Vault(spark, sf)["turns"], CTX_TURNS, CTX_BUDGET)


@query("gate_sessions")
def q_gate_sessions(spark, sf):
    from lorekit.operators.transcripts import MIN_TURNS_COMPACT, gate_sessions, session_context
    ctx = session_context(Vault(spark, sf)["turns"])
    return gate_sessions(ctx, MIN_TURNS_COMPACT).select("session_id", "n_turns")


# ── Secrets and findings ──────────────────────────────────────────────

FINDING_GLOBS = ("docs/src1/*", "docs/src1?/*")


@query("redact")
def q_redact(spark, sf):
    from lorekit.functions.text import redact
    d = Vault(spark, sf)["documents"]
    r = d.select("doc_id", "text", redact("text").alias("redacted"))
    return r.where(F.col("redacted") != F.col("text")).select("doc_id", "redacted")


@query("secret_findings")
def q_secret_findings(spark, sf):
    from lorekit.operators.secrets import secret_findings
    return secret_findings(Vault(spark, sf)["documents"])


def _findings(v: Vault) -> DataFrame:
    return v["findings"].select("file", "line", "title", "category", "severity", "hit_pos")


@query("findings_from_documents")
def q_findings(spark, sf):
    return _findings(Vault(spark, sf))


@query("severity_counts")
def q_severity_counts(spark, sf):
    from lorekit.operators.secrets import severity_counts
    return severity_counts(_findings(Vault(spark, sf)))


@query("ignore_findings")
def q_ignore_findings(spark, sf):
    from lorekit.operators.secrets import ignore_findings
    return ignore_findings(_findings(Vault(spark, sf)), FINDING_GLOBS)


@query("ignored_findings_report")
def q_ignored_findings_report(spark, sf):
    """The kept findings with the number of ignored ones, which the same pass observes."""
    from lorekit.operators.secrets import ignored_report
    return ignored_report(_findings(Vault(spark, sf)), FINDING_GLOBS)


@query("critical_alerts")
def q_critical_alerts(spark, sf):
    from lorekit.operators.secrets import critical_alerts
    f = _findings(Vault(spark, sf)).withColumn("scan", F.regexp_extract("file", r"^(docs/[^/]+)/", 1))
    return critical_alerts(f, "scan")


# ── Observations ──────────────────────────────────────────────────────

OBS_AS_OF = "2024-01-30 12:00:00"
HINT_THRESHOLD, HINT_INTERVAL = 20, 10
THROTTLE_SECONDS = 6 * 3600


@query("running_tool_calls")
def q_running_tool_calls(spark, sf):
    from lorekit.operators.observations import running_tool_calls
    return running_tool_calls(Vault(spark, sf)["observations"]).select("session_id", "seq", "tool_call_num")


@query("compact_hints")
def q_compact_hints(spark, sf):
    from lorekit.operators.observations import compact_hints, running_tool_calls
    c = running_tool_calls(Vault(spark, sf)["observations"])
    return compact_hints(c, HINT_THRESHOLD, HINT_INTERVAL).select("session_id", "seq", "tool_call_num")


@query("filter_recent")
def q_filter_recent(spark, sf):
    from lorekit.operators.observations import filter_recent, gate_min_count
    r = filter_recent(Vault(spark, sf)["observations"], OBS_AS_OF)
    return gate_min_count(r).select("session_id", "seq", "event", "tool")


@query("observation_tail")
def q_observation_tail(spark, sf):
    from lorekit.operators.observations import filter_recent, gate_min_count, observation_tail
    r = gate_min_count(filter_recent(Vault(spark, sf)["observations"], OBS_AS_OF))
    return observation_tail(r).select("seq", "line")


@query("throttle")
def q_throttle(spark, sf):
    from lorekit.operators.observations import throttle
    t = throttle(Vault(spark, sf)["observations"], "session_id", THROTTLE_SECONDS)
    return t.select("session_id", "seq")


# ── Instincts ─────────────────────────────────────────────────────────

SPLIT_DATE = "2024-01-11"
PRUNE_AS_OF = "2024-02-28 12:00:00"


def _instincts(v: Vault):
    """Two upsert passes: proposals before SPLIT_DATE build the existing table,
    the rest are applied to it."""
    from lorekit.operators.instincts import merge_evidence, upsert_instincts
    c = v.cached("proposals", lambda: v["candidates"])

    def passes():
        first, ev1 = upsert_instincts(None, c.where(F.col("date") < SPLIT_DATE))
        final, ev2 = upsert_instincts(first, c.where(F.col("date") >= SPLIT_DATE))
        return final, merge_evidence(ev1, ev2)
    return v.cached("instincts", lambda: passes()[0]), v.cached("instinct_evidence", lambda: passes()[1])


def _fmt_dates(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.date_format(c, "yyyy-MM-dd"))
    return df


@query("parse_yaml_blocks")
def q_parse_yaml_blocks(spark, sf):
    from lorekit.operators.instincts import parse_yaml_blocks
    from lorekit.sources.adapters import proposals_from_candidates
    p = parse_yaml_blocks(proposals_from_candidates(Vault(spark, sf)["candidates"]))
    return p.withColumn("confidence", F.col("confidence").cast("decimal(6,2)"))


@query("upsert_instincts")
def q_upsert_instincts(spark, sf):
    inst, ev = _instincts(Vault(spark, sf))
    n_ev = ev.groupBy("key").agg(F.count(F.lit(1)).alias("n_evidence"))
    out = inst.join(n_ev, "key", "left").select(
        "key", "trigger", "action", "domain", "confidence", "source", "evidence_count", "created", "last_seen",
        "updated", F.coalesce("n_evidence", F.lit(0)).cast("bigint").alias("n_evidence"))
    return _fmt_dates(out, "created", "last_seen", "updated")


@query("list_instincts")
def q_list_instincts(spark, sf):
    from lorekit.operators.instincts import list_instincts
    inst, _ = _instincts(Vault(spark, sf))
    return list_instincts(inst, "src3", "view", 0.5).select("key", "confidence")


@query("top_instincts")
def q_top_instincts(spark, sf):
    from lorekit.operators.instincts import top_instincts
    inst, _ = _instincts(Vault(spark, sf))
    return top_instincts(inst).select("key", "line")


@query("prune_instincts")
def q_prune_instincts(spark, sf):
    from lorekit.operators.instincts import prune_instincts
    inst, _ = _instincts(Vault(spark, sf))
    return prune_instincts(inst, PRUNE_AS_OF)


@query("resolve_instinct")
def q_resolve_instinct(spark, sf):
    from lorekit.operators.instincts import resolve_instinct
    v = Vault(spark, sf)
    inst, _ = _instincts(v)
    t = v["events"].select("event_type").distinct()
    prefixes = t.select(F.col("event_type").alias("prefix")).unionByName(
        t.select(F.concat("event_type", F.lit("-1")).alias("prefix")))
    return resolve_instinct(inst, prefixes)


@query("render_instincts")
def q_render_instincts(spark, sf):
    from lorekit.operators.instincts import render_instincts
    inst, _ = _instincts(Vault(spark, sf))
    return render_instincts(inst)


@query("parse_instinct_files")
def q_parse_instinct_files(spark, sf):
    """Rendered files parsed back: the round trip of every instinct."""
    from lorekit.operators.instincts import parse_instinct_files, render_instincts
    inst, _ = _instincts(Vault(spark, sf))
    files = render_instincts(inst).select(F.concat("key", F.lit(".md")).alias("name"), F.col("text").alias("content"))
    out = parse_instinct_files(files).select(
        "key", "trigger", "action", "domain", "confidence", "source", "evidence_count", "created", "last_seen", "updated",
        F.array_join("projects", " | ").alias("projects_list"))
    return _fmt_dates(out, "created", "last_seen", "updated")


def _clusters(v: Vault):
    from lorekit.operators.instincts import parse_cluster_json
    from lorekit.sources.adapters import cluster_proposals_from_instincts
    inst, ev = _instincts(v)
    return inst, ev, parse_cluster_json(cluster_proposals_from_instincts(inst))


@query("parse_cluster_json")
def q_parse_cluster_json(spark, sf):
    _, _, c = _clusters(Vault(spark, sf))
    return c.select("response_id", "cluster", "canonical_id", *_list_cols("duplicate_ids"),
                    "merged_trigger", "merged_action", "merged_domain")


@query("merge_clusters")
def q_merge_clusters(spark, sf):
    from lorekit.operators.instincts import merge_clusters
    inst, ev, c = _clusters(Vault(spark, sf))
    merged, _ = merge_clusters(inst, ev, c)
    out = merged.select("key", F.col("n_members").cast("bigint").alias("n_members"), "trigger", "action", "domain",
                        "confidence", "evidence_count", *_list_cols("projects"), "created", "last_seen")
    return _fmt_dates(out, "created", "last_seen")


@query("merge_clusters_deleted")
def q_merge_clusters_deleted(spark, sf):
    from lorekit.operators.instincts import merge_clusters
    inst, ev, c = _clusters(Vault(spark, sf))
    _, deleted = merge_clusters(inst, ev, c)
    return deleted.select("key")


@query("merged_evidence")
def q_merged_evidence(spark, sf):
    from lorekit.operators.instincts import merge_clusters, merged_evidence
    inst, ev, c = _clusters(Vault(spark, sf))
    return merged_evidence(ev, *merge_clusters(inst, ev, c))


# ── Daily logs ────────────────────────────────────────────────────────

POINTER_AS_OF = "2024-01-31 10:00:00"


@query("section_counts")
def q_section_counts(spark, sf):
    from lorekit.operators.dailies import scoped_headers, section_counts
    v = Vault(spark, sf)
    return section_counts(scoped_headers(v["dailies"], v["registry"]))


@query("daily_projects")
def q_daily_projects(spark, sf):
    from lorekit.operators.dailies import daily_projects
    return daily_projects(Vault(spark, sf)["sections"]).select("name", *_list_cols("projects"))


@query("pending_dailies")
def q_pending_dailies(spark, sf):
    from lorekit.operators.dailies import pending_dailies
    v = Vault(spark, sf)
    return pending_dailies(v["dailies"], v["state"])


@query("autocompile_due")
def q_autocompile_due(spark, sf):
    """Check at each session's last event: is that day's daily due?"""
    from lorekit.operators.dailies import autocompile_due
    v = Vault(spark, sf)
    checks = v["events"].groupBy("user_id", F.to_date("ts").alias("d")).agg(F.max("ts").alias("at"))
    return autocompile_due(checks, v["dailies"], v["state"]).select("user_id", "name")


@query("render_daily")
def q_render_daily(spark, sf):
    from lorekit.operators.dailies import render_daily
    v = Vault(spark, sf)
    f = v["events"].groupBy("user_id", F.to_date("ts").alias("d")).agg(
        F.max("ts").alias("ts"), F.count(F.lit(1)).alias("n"))
    f = f.select("ts", F.concat(F.lit("Src"), (F.col("user_id") % 20).cast("string")).alias("canonical"),
                 F.concat(F.col("n").cast("string"), F.lit(" tool events")).alias("body"))
    r = render_daily(f)
    return r.select("name", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "text")


@query("latest_daily_pointer")
def q_latest_daily_pointer(spark, sf):
    from lorekit.operators.dailies import latest_daily_pointer
    v = Vault(spark, sf)
    return latest_daily_pointer(v["dailies"], v["registry"], POINTER_AS_OF)


# ── Attribution ───────────────────────────────────────────────────────

def _attribution(v: Vault):
    from lorekit.operators.attribution import attribute_articles, narrow_by_mention
    from lorekit.operators.extract import extract_sources
    derived = v.cached("derived", lambda: attribute_articles(v["articles"], extract_sources(v["articles"]), v["sections"]))
    return derived, v.cached("narrowed", lambda: narrow_by_mention(v["articles"], derived, v["registry"]))


def _day_attribution(v: Vault):
    """The same with a source that names a day's log standing for all logs of that day."""
    from lorekit.operators.attribution import attribute_articles, narrow_by_mention
    from lorekit.operators.dailies import day_log
    from lorekit.operators.extract import extract_sources
    sections = v["sections"].withColumn("name", day_log("name"))
    derived = v.cached("day_derived", lambda: attribute_articles(v["articles"], extract_sources(v["articles"]), sections))
    return derived, v.cached("day_narrowed", lambda: narrow_by_mention(v["articles"], derived, v["registry"]))


def _backfill(v: Vault) -> DataFrame:
    from lorekit.operators.attribution import backfill_projects
    d, n = _attribution(v)
    return v.cached("backfill", lambda: backfill_projects(v["articles"], d, n, v["links"]))


@query("attribute_articles")
def q_attribute_articles(spark, sf):
    d, _ = _attribution(Vault(spark, sf))
    return d.select("slug", *_list_cols("derived"))


@query("narrow_by_mention")
def q_narrow_by_mention(spark, sf):
    _, n = _attribution(Vault(spark, sf))
    return n.select("slug", *_list_cols("narrowed"))


@query("backfill_projects_one_hop")
def q_backfill_projects_one_hop(spark, sf):
    """First slice of SURVEY §2.13-D: connections/qa inherit from changed concepts only; all logs of a source's day count."""
    from lorekit.operators.attribution import backfill_projects
    v = Vault(spark, sf)
    b = backfill_projects(v["articles"], *_day_attribution(v), v["links"])
    return b.select("slug", "kind", *_list_cols("existing"), *_list_cols("projects"))


# ── Digest, bundle, file-back ─────────────────────────────────────────

DIGEST_AS_OF = "2024-01-31 10:00:00"
DIGEST_PROJECT = "Src3"


@query("session_digest")
def q_session_digest(spark, sf):
    from lorekit.operators.dailies import latest_daily_pointer, log_number
    from lorekit.operators.digest import DAILY_LABELS, session_digest
    from lorekit.operators.scope import classify_scope
    from lorekit.sources.adapters import load, wiki_lines_from_pages
    v = Vault(spark, sf)
    scoped = classify_scope(v["index_rows"], v["articles"], _aliases_of(spark, v, DIGEST_PROJECT))
    inst, _ = _instincts(v)
    labels = F.create_map(*[F.lit(x) for kv in DAILY_LABELS.items() for x in kv])
    first = v["dailies"].where(log_number("name") == 0)
    ptr = (latest_daily_pointer(first, v["registry"], DIGEST_AS_OF)
           .where(F.col("project") == DIGEST_PROJECT).withColumn("label_text", labels[F.col("label")]))
    project = v["registry"].where(F.col("canonical") == DIGEST_PROJECT).select("canonical", "id")
    d = session_digest(scoped, project, inst, wiki_lines_from_pages(load(spark, sf, "pages")), ptr, DIGEST_AS_OF)
    return d.select(F.col("part").cast("bigint").alias("part"), "pos", "text")


@query("other_rows_capped")
def q_other_rows_capped(spark, sf):
    from lorekit.operators.digest import other_rows_capped
    from lorekit.operators.scope import classify_scope
    v = Vault(spark, sf)
    scoped = classify_scope(v["index_rows"], v["articles"], _aliases_of(spark, v, DIGEST_PROJECT))
    return other_rows_capped(scoped.where(F.col("scope") == "other"))


@query("knowledge_bundle")
def q_knowledge_bundle(spark, sf):
    from lorekit.operators.digest import knowledge_bundle
    from lorekit.operators.scope import filter_articles_by_project
    v = Vault(spark, sf)
    kept = filter_articles_by_project(v["articles"], _aliases_of(spark, v, SCOPE_PROJECT))
    arts = v["articles"].join(kept.select("slug"), "slug", "left_semi")
    return knowledge_bundle(v["index_rows"], arts).select(
        F.col("kind_ord").cast("bigint").alias("kind_ord"), "slug", "n_chars", "cum_chars")


def _file_back(spark, sf):
    from lorekit.operators.digest import file_back_qa
    from lorekit.sources.adapters import qa_from_conversations
    return file_back_qa(qa_from_conversations(Vault(spark, sf)["conversations"]))


@query("file_back_qa")
def q_file_back_qa(spark, sf):
    arts, _ = _file_back(spark, sf)
    return arts


@query("file_back_log")
def q_file_back_log(spark, sf):
    _, log = _file_back(spark, sf)
    return log.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "entry")


@query("wiki_page_count")
def q_wiki_page_count(spark, sf):
    from lorekit.operators.digest import wiki_page_count
    from lorekit.sources.adapters import load, wiki_lines_from_pages
    return wiki_page_count(wiki_lines_from_pages(load(spark, sf, "pages")))


# ── Duplicates ────────────────────────────────────────────────────────

@query("exact_duplicates")
def q_exact_duplicates(spark, sf):
    from lorekit.operators.duplicates import exact_duplicates
    return exact_duplicates(Vault(spark, sf)["documents"])


@query("near_duplicate_documents")
def q_near_duplicate_documents(spark, sf):
    """Approximate (MinHash LSH) clusters: checked rows-only and by tests of links and recall."""
    from lorekit.operators.duplicates import near_duplicates
    return near_duplicates(Vault(spark, sf)["documents"])


@query("near_duplicate_instincts")
def q_near_duplicate_instincts(spark, sf):
    from lorekit.operators.duplicates import near_duplicates
    inst, _ = _instincts(Vault(spark, sf))
    rows = inst.select("key", F.concat_ws(" ", "trigger", "action").alias("text"))
    return near_duplicates(rows, key="key", text="text", shingle=2, md5_hash=True)


# ── Raw records derived from the tables ───────────────────────────────

@query("flatten_turns")
def q_flatten_turns(spark, sf):
    from lorekit.operators.transcripts import flatten_turns
    from lorekit.sources.adapters import transcript_lines_from_conversations
    return flatten_turns(transcript_lines_from_conversations(Vault(spark, sf)["conversations"]))


@query("summarize_tool_events")
def q_summarize_tool_events(spark, sf):
    from lorekit.operators.observations import classify_tool_results, summarize_tool_events
    from lorekit.sources.adapters import hook_events_from_events
    h = classify_tool_results(summarize_tool_events(hook_events_from_events(Vault(spark, sf)["events"])))
    return h.select("event_id", "input_summary", "success", "error")


@query("parse_index_rows")
def q_parse_index_rows(spark, sf):
    from lorekit.operators.extract import parse_index_rows
    p = parse_index_rows(Vault(spark, sf)["index_rows"])
    return p.select("pos", F.size("cells").cast("bigint").alias("n_cells"), F.element_at("cells", 1).alias("cell1"),
                    F.element_at("cells", 2).alias("cell2"), F.element_at("cells", 3).alias("cell3"), "slug")


@query("extract_headers_scoped")
def q_extract_headers_scoped(spark, sf):
    from lorekit.operators.extract import extract_headers_scoped
    return extract_headers_scoped(Vault(spark, sf)["dailies"]).select(
        "name", F.col("pos").cast("bigint").alias("pos"), "header_project")


@query("inherit_projects")
def q_inherit_projects(spark, sf):
    """Projects connections/qa inherit from changed concepts (the donors of backfill)."""
    from lorekit.operators.attribution import inherit_projects
    v = Vault(spark, sf)
    donors = _backfill(v).where(F.col("kind") == "concepts").select("slug", "projects")
    arts = v["articles"].where(F.col("kind") != "concepts")
    return inherit_projects(arts, v["links"], donors).select("slug", *_list_cols("inherited"))


@query("parse_issue_json")
def q_parse_issue_json(spark, sf):
    """A model response per article: a JSON list with an object, a number and an object without file."""
    from lorekit.operators.lint import parse_issue_json
    a = Vault(spark, sf)["articles"]
    txt = F.concat(F.lit('Found: [{"file": "'), F.col("slug"), F.lit('.md", "detail": "only '),
                   F.col("n_words").cast("string"), F.lit(' words"}, 7, {"detail": "see '), F.col("slug"), F.lit('"}] ok'))
    r = a.select("slug", txt.alias("text"))
    return parse_issue_json(r).select("severity", "check", "file", "detail")


@query("backfill_projects")
def q_backfill_projects(spark, sf):
    """The reference's order-dependent rule (chains of inheritance), solved by pointer jumping, with the rewritten
    article; the oracle is a recursive CTE, and a test runs the rules by brute force."""
    from lorekit.operators.attribution import backfill_projects_ordered
    v = Vault(spark, sf)
    _, n = _attribution(v)
    b = backfill_projects_ordered(v["articles"], n)
    return b.select("slug", "kind", *_list_cols("existing"), *_list_cols("projects"), "content")


# ── Parsers of raw texts ──────────────────────────────────────────────

@query("repair_json")
def q_repair_json(spark, sf):
    """Hook payloads, some with lone backslashes, some no JSON at all."""
    from lorekit.operators.transcripts import repair_json
    from lorekit.sources.adapters import broken_payloads_from_events
    v = broken_payloads_from_events(Vault(spark, sf)["events"]).withColumn("v", repair_json("payload"))
    return v.select("event_id", F.try_variant_get("v", "$.path", "string").alias("path"), F.try_variant_get("v", "$.k", "bigint").alias("k"))


@query("extract_evidence")
def q_extract_evidence(spark, sf):
    from lorekit.operators.instincts import extract_evidence
    from lorekit.sources.adapters import evidence_files_from_instincts
    _, ev = _instincts(Vault(spark, sf))
    return extract_evidence(evidence_files_from_instincts(ev)).select("key", F.col("pos").cast("bigint").alias("pos"), "line")


@query("parse_registry")
def q_parse_registry(spark, sf):
    from lorekit.sources.adapters import registry_texts
    from lorekit.sources.scan import parse_registry
    r = parse_registry(registry_texts(Vault(spark, sf)["registry"]))
    return r.select("team", "ord", "id", "name", "canonical", *_list_cols("aliases"), "root", "remote")


@query("parse_compile_state")
def q_parse_compile_state(spark, sf):
    from lorekit.sources.adapters import state_texts
    from lorekit.sources.scan import parse_compile_state
    return parse_compile_state(state_texts(Vault(spark, sf)["state"]))


@query("parse_findings")
def q_parse_findings(spark, sf):
    from lorekit.sources.adapters import finding_reports
    from lorekit.sources.scan import parse_findings
    f = parse_findings(finding_reports(_findings(Vault(spark, sf))))
    return f.withColumn("idx", F.col("idx").cast("bigint"))


@query("scan_build_log")
def q_scan_build_log(spark, sf):
    from lorekit.sources.adapters import build_logs_from_answers, qa_from_conversations
    from lorekit.sources.scan import scan_build_log
    b = scan_build_log(build_logs_from_answers(qa_from_conversations(Vault(spark, sf)["conversations"])))
    return b.select("name", F.col("pos").cast("bigint").alias("pos"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "op", "description", *_list_cols("details"))


# ── The same through SQL ──────────────────────────────────────────────

from lorekit.plans.views import SQL_QUERIES, run_sql  # noqa: E402

for _name in SQL_QUERIES:
    query(_name)(run_sql(_name))
