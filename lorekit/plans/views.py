"""The library in SQL: its tables and results as temporary views, and table functions over them.

``register_views`` names each view ``kb_<table>`` in the session; a table that several views share is built once and
kept (see ``vault``). The functions take their arguments in SQL and are expanded into the query that calls them, so
filters and joins are planned together with the views."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekit.operators import lint
from lorekit.operators.observations import running_tool_calls
from lorekit.operators.transcripts import clean_turns, session_context
from lorekit.plans.vault import Vault

PREFIX = "kb_"


def _instincts(v: Vault) -> DataFrame:
    from lorekit.plans.catalog import _instincts
    return _instincts(v)[0]


VIEWS: dict[str, Callable[[Vault], DataFrame]] = {
    "articles": lambda v: v["articles"], "links": lambda v: v["links"], "frontmatter": lambda v: v["frontmatter"],
    "dailies": lambda v: v["dailies"], "sections": lambda v: v["sections"], "registry": lambda v: v["registry"],
    "issues": lint.lint_all, "hubs": lambda v: lint.hub_concepts(v["articles"], v["links"]),
    "observations": lambda v: v["observations"], "tool_calls": lambda v: running_tool_calls(v["observations"]),
    "turns": lambda v: clean_turns(v["turns"]), "contexts": lambda v: session_context(v["turns"]),
    "findings": lambda v: v["findings"], "instincts": _instincts,
}

#: name: (views it reads, parameters, columns, body)
FUNCTIONS = {
    "links_to": (["links"], "article STRING", "src STRING, pos INT, raw STRING",
                 "SELECT src, pos, raw FROM kb_links WHERE target = kb_links_to.article AND NOT is_daily"),
    "issues_of": (["issues"], "article STRING", "severity STRING, check STRING, detail STRING",
                  "SELECT severity, check, detail FROM kb_issues WHERE file = kb_issues_of.article"),
    "sections_of": (["sections"], "wanted STRING", "name STRING, header STRING, pos INT",
                    "SELECT name, header, pos FROM kb_sections WHERE lower(project) = lower(kb_sections_of.wanted)"),
}


def register_views(spark: SparkSession, sf_dir: str, names: Iterable[str] | None = None) -> list[str]:
    """Create the views ``names`` (all if not given) and the functions that need no others; returns what was created.
    Names of views are given without their prefix."""
    wanted, v = list(VIEWS) if names is None else list(names), Vault(spark, sf_dir)
    for name in wanted:
        VIEWS[name](v).createOrReplaceTempView(PREFIX + name)
    made = [PREFIX + name for name in wanted]
    for name, (needs, args, columns, body) in FUNCTIONS.items():
        if set(needs) <= set(wanted):
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {PREFIX}{name}({args}) RETURNS TABLE ({columns}) RETURN {body}")
            made.append(PREFIX + name)
    return made


#: Queries of each family as a user writes them: (views, SQL).
SQL_QUERIES = {
    "sql_issue_counts": (["issues"], "SELECT severity, check, count(*) AS n, count(DISTINCT file) AS n_files FROM kb_issues GROUP BY severity, check"),
    "sql_links_to_hubs": (["articles", "hubs", "links"], """
        SELECT h.slug, h.n_inbound, count(*) AS n_mentions, min(l.src) AS first_src
        FROM kb_hubs h JOIN kb_articles a ON a.slug = h.slug, LATERAL kb_links_to(h.slug) l WHERE a.kind = 'concepts' GROUP BY h.slug, h.n_inbound"""),
    "sql_project_sections": (["sections", "registry"], """
        SELECT r.canonical AS project, count(*) AS n, count(DISTINCT s.name) AS n_dailies FROM kb_registry r, LATERAL kb_sections_of(r.canonical) s GROUP BY r.canonical"""),
    "sql_session_calls": (["observations", "tool_calls"], """
        SELECT o.project, count(DISTINCT o.session_id) AS n_sessions, max(c.tool_call_num) AS most_calls
        FROM kb_observations o JOIN kb_tool_calls c ON c.session_id = o.session_id AND c.seq = o.seq GROUP BY o.project"""),
    "sql_turn_sizes": (["turns"], "SELECT role, count(*) AS n, count(DISTINCT session_id) AS n_sessions, sum(length(text)) AS n_chars FROM kb_turns GROUP BY role"),
    "sql_finding_files": (["findings"], """
        SELECT title, coalesce(severity, 'unknown') AS severity, count(DISTINCT file) AS n_files, min(line) AS first_line FROM kb_findings GROUP BY 1, 2"""),
    "sql_instinct_domains": (["instincts"], """
        SELECT domain, count(*) AS n, max(confidence) AS confidence, sum(evidence_count) AS evidence_count FROM kb_instincts GROUP BY domain"""),
}


def run_sql(name: str) -> Callable[[SparkSession, str], DataFrame]:
    views, sql = SQL_QUERIES[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register_views(spark, sf_dir, views)
        return spark.sql(sql)
    run.__doc__ = f"``spark.sql`` over the views {', '.join(PREFIX + v for v in views)}."
    return run
