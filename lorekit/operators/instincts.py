"""Instincts (trigger → action rows): parse proposals, upsert with confidence,
list / rank / prune, and merge duplicate clusters.

The reference folds proposals one at a time; here the fold has a closed form per
key (first confidence, number of repeats, caps), so an upsert is one groupBy
plus one full-outer join with the existing table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekit.functions.text import py_lines, py_lstrip, py_rstrip, py_strip, slugify, strip_quotes, title_from_id

# ── Fixed values ──────────────────────────────────────────────────────
DEFAULT_CONFIDENCE = "0.30"
CONFIDENCE_STEP = "0.10"
CONFIDENCE_CAP = "0.90"
PRUNE_BELOW = "0.3"
STALE_DAYS = 30
MIN_SHOWN_CONFIDENCE = "0.5"
DEFAULT_NOTE = "observed in session"
SOURCE = "session-observation"
YAML_BLOCK = r"(?s)```ya?ml\s*\n(.*?)\n```"
JSON_OBJECT = r"(?s)\{.*\}"
CONF = "decimal(6,2)"
CELL_CUTS = (60, 60, 18)


def instinct_key(id_col, trigger_col) -> F.Column:
    """slugify(id)[:60], else slugify(trigger)[:60], else ``unnamed``."""
    a = F.substring(slugify(F.coalesce(id_col, F.lit(""))), 1, 60)
    b = F.substring(slugify(F.coalesce(trigger_col, F.lit(""))), 1, 60)
    return F.when(a != "", a).when(b != "", b).otherwise(F.lit("unnamed"))


def py_float_text(dec) -> F.Column:
    """How Python prints a float rounded to 2 places: 0.40 → 0.4, 1.00 → 1.0."""
    return F.regexp_replace(dec.cast("string"), r"(\.\d)0$", "$1")


# ── Proposals ─────────────────────────────────────────────────────────

def parse_yaml_blocks(responses: DataFrame, id_col: str = "response_id", text_col: str = "text") -> DataFrame:
    """Fenced yaml/yml blocks of each response as rows (response_id, block, id,
    trigger, action, domain, confidence, evidence). Lines: ``key: value``, value
    stripped of spaces and quotes, empty values dropped, last duplicate wins; a
    confidence that is not a number becomes 0.3. Blocks without id, trigger and
    action are dropped."""
    b = responses.select(F.col(id_col).alias("response_id"),
                         F.posexplode(F.regexp_extract_all(F.col(text_col), F.lit(YAML_BLOCK), 1)).alias("block", "y"))
    # a block is one bounded row: its lines are parsed within it, and one shuffle brings together what its keys hold
    numbered = F.transform(py_lines("y"), lambda line, i: F.struct(i.alias("pos"), py_rstrip(line).alias("line")))
    pairs = F.transform(F.filter(numbered, lambda x: x["line"].contains(":") & ~py_lstrip(x["line"]).startswith("#")), lambda x: F.struct(
        x["pos"], py_strip(F.substring_index(x["line"], ":", 1)).alias("key"),
        strip_quotes(py_strip(F.substr(x["line"], F.instr(x["line"], ":") + 1))).alias("val")))
    kv = b.select("response_id", "block", F.filter(pairs, lambda x: (x["key"] != "") & (x["val"] != "")).alias("kv"))

    def last(k):
        return F.try_element_at(F.filter("kv", lambda x: x["key"] == k), F.lit(-1)).alias(k)
    keys = ("id", "trigger", "action", "domain", "confidence", "evidence")
    g = kv.select("response_id", "block", *[last(k) for k in keys]).groupBy("response_id", "block").agg(
        *[F.max_by(f"{k}.val", f"{k}.pos").alias(k) for k in keys])
    conf = F.when(F.col("confidence").isNull(), F.lit(None)).otherwise(
        F.coalesce(F.expr("try_cast(confidence AS double)"), F.lit(0.3)))
    return g.where(F.col("id").isNotNull() & F.col("trigger").isNotNull() & F.col("action").isNotNull()).select(
        "response_id", F.col("block").cast("bigint").alias("block"), "id", "trigger", "action", "domain",
        conf.alias("confidence"), "evidence")


# ── Upsert ────────────────────────────────────────────────────────────

INSTINCT_COLS = ["key", "trigger", "action", "domain", "confidence", "source", "evidence_count",
                 "created", "last_seen", "updated"]


def upsert_instincts(existing: DataFrame | None, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply proposals in ``ts`` order to the instinct table; returns (instincts, evidence).

    Per key: new → confidence as given (default 0.3, 2 dp), count 1; each repeat
    → min(0.9, conf + 0.1), count + 1. Closed form with n proposals: n = 1 → c₁,
    else min(0.9, c₁ + 0.1·(n−1)); on an existing row e with m repeats →
    min(0.9, e + 0.1·m). Trigger/action from the latest proposal, domain from the
    latest proposal that has one (else existing, else ``general``); projects become
    ``[shared]`` on the rows that a proposal touches; created = first, last_seen = updated = latest proposal date.
    Evidence lines ``- date: note`` are kept once each (exact-line distinct)."""
    c = candidates.select(
        instinct_key(F.col("id"), F.col("trigger")).alias("key"), "trigger", "action", "domain",
        F.round(F.coalesce(F.col("confidence").cast("double"), F.lit(0.3)), 2).cast(CONF).alias("conf"),
        F.coalesce(F.col("evidence"), F.lit(DEFAULT_NOTE)).alias("note"), "ts",
        F.to_date("ts").alias("date"))
    order = F.struct("ts", "trigger", "action", "conf", "domain", "note")     # total, whatever the partitioning
    g = c.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(order)["conf"].alias("c1"),
        F.max(order).alias("last"),
        F.max(F.when(F.col("domain").isNotNull(), order))["domain"].alias("domain_new"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    cap, step = F.lit(CONFIDENCE_CAP).cast(CONF), F.lit(CONFIDENCE_STEP).cast(CONF)
    ev_new = c.select("key", F.concat(F.lit("- "), F.date_format("date", "yyyy-MM-dd"), F.lit(": "), F.col("note")).alias("line"),
                      "ts")
    keep_projects = existing is not None and "projects" in existing.columns
    if existing is None:
        e = None
    else:
        e = existing.select(F.col("key").alias("key"), F.col("domain").alias("e_domain"),
                            F.col("confidence").cast(CONF).alias("e_conf"), F.col("source").alias("e_source"),
                            F.col("evidence_count").alias("e_count"), F.col("created").alias("e_created"),
                            *[F.col(x).alias(f"e_{x}") for x in ("trigger", "action", "last_seen", "updated", *["projects"] * keep_projects)])
    j = g if e is None else g.join(e, "key", "full_outer")
    has_e = F.lit(False) if e is None else F.col("e_conf").isNotNull() | F.col("e_count").isNotNull()
    has_n = F.col("n").isNotNull()
    conf_new = F.when(F.col("n") == 1, F.col("c1")).otherwise(F.least(cap, F.col("c1") + step * (F.col("n") - 1)))
    conf_rep = F.least(cap, F.col("e_conf") + step * F.col("n")) if e is not None else F.lit(None)
    out = j.select(
        "key",
        F.when(has_n, F.col("last.trigger")).otherwise(F.col("e_trigger") if e is not None else F.lit(None)).alias("trigger"),
        F.when(has_n, F.col("last.action")).otherwise(F.col("e_action") if e is not None else F.lit(None)).alias("action"),
        F.coalesce("domain_new", *( [F.col("e_domain")] if e is not None else []), F.lit("general")).alias("domain"),
        F.when(~has_n, F.col("e_conf") if e is not None else F.lit(None)).when(has_e, conf_rep).otherwise(conf_new)
        .cast(CONF).alias("confidence"),
        (F.coalesce(F.col("e_source"), F.lit(SOURCE)) if e is not None else F.lit(SOURCE)).alias("source"),
        (F.coalesce(F.col("e_count"), F.lit(0)) + F.coalesce(F.col("n"), F.lit(0)) if e is not None
         else F.col("n")).cast("bigint").alias("evidence_count"),
        (F.coalesce(F.col("e_created"), F.col("first_date")) if e is not None else F.col("first_date")).alias("created"),
        F.when(has_n, F.col("last_date")).otherwise(F.col("e_last_seen") if e is not None else F.lit(None)).alias("last_seen"),
        F.when(has_n, F.col("last_date")).otherwise(F.col("e_updated") if e is not None else F.lit(None)).alias("updated"),
        (F.when(has_n, F.array(F.lit("shared"))).otherwise(F.col("e_projects")) if keep_projects
         else F.array(F.lit("shared"))).alias("projects"),
    )
    return out, ev_new


def merge_evidence(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """Evidence lines per key, each kept once, ordered by first appearance."""
    u = new if old is None else old.unionByName(new)
    return u.groupBy("key", "line").agg(F.min("ts").alias("ts"))


# ── Listing, ranking, pruning ─────────────────────────────────────────

def list_instincts(instincts: DataFrame, project: str | None = None, domain: str | None = None,
                   min_conf: float = 0.0) -> DataFrame:
    """Filter by project (or ``shared``), domain ignoring case, confidence ≥ min;
    sorted by confidence descending, then id (file name)."""
    x = instincts
    if project:
        low = F.transform(F.coalesce("projects", F.array().cast("array<string>")), F.lower)
        x = x.where(F.array_contains(low, project.lower()) | F.array_contains(low, "shared"))
    if domain:
        x = x.where(F.lower(F.coalesce("domain", F.lit(""))) == domain.lower())
    x = x.where(F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)) >= min_conf)
    return x.orderBy(F.col("confidence").desc(), F.col("key"))


def top_instincts(instincts: DataFrame, min_conf: str = MIN_SHOWN_CONFIDENCE) -> DataFrame:
    """Digest rows ``| trigger | action | domain | conf | last_seen |`` for confidence
    ≥ 0.5, ordered by confidence desc, last_seen asc, id; cells cut 60/60/18."""
    x = instincts.where(F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)) >= float(min_conf))
    t, a, d = CELL_CUTS
    line = F.concat(
        F.lit("| "), F.substring(F.coalesce(F.nullif("trigger", F.lit("")), F.lit("-")), 1, t), F.lit(" | "),
        F.substring(F.coalesce(F.nullif("action", F.lit("")), F.lit("-")), 1, a), F.lit(" | "),
        F.substring(F.coalesce(F.nullif("domain", F.lit("")), F.lit("-")), 1, d), F.lit(" | "),
        py_float_text(F.col("confidence")), F.lit(" | "),
        F.coalesce(F.date_format("last_seen", "yyyy-MM-dd"), F.lit("-")), F.lit(" |"))
    return x.select("key", "confidence", "last_seen", line.alias("line")).orderBy(
        F.col("confidence").desc(), F.col("last_seen").asc(), F.col("key"))


def prune_instincts(instincts: DataFrame, as_of: str, stale_days: int = STALE_DAYS) -> DataFrame:
    """(key, reason): confidence < 0.3 first; else last_seen (midnight UTC) older
    than as_of − 30 days. A missing confidence counts as 0, a bad date is kept."""
    conf = F.coalesce(F.col("confidence").cast("decimal(6,2)"), F.lit(0).cast("decimal(6,2)"))
    last = F.col("last_seen").cast("timestamp")
    cutoff = F.expr(f"timestamp'{as_of}' - INTERVAL {int(stale_days)} DAYS")
    reason = (F.when(conf < F.lit(PRUNE_BELOW).cast("decimal(6,2)"),
                     F.concat(F.lit("confidence="), F.format_number(conf, 2).cast("string"), F.lit("<0.3")))
              .when(last < cutoff, F.concat(F.lit("last_seen="), F.date_format("last_seen", "yyyy-MM-dd"),
                                            F.lit(f" >{stale_days}d ago"))))
    return instincts.select("key", reason.alias("reason")).where(F.col("reason").isNotNull())


def resolve_instinct(instincts: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(prefix, key): the exact id, else the smallest id starting with the prefix."""
    k = instincts.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.length("key")),
                                                     lambda i: F.substring("key", 1, i))).alias("prefix"))
    j = prefixes.join(k, "prefix")    # equi-join on every prefix of a key (keys are at most 60 chars)
    return j.groupBy("prefix").agg(F.min_by("key", F.struct((F.col("key") != F.col("prefix")).alias("x"),
                                                            F.col("key"))).alias("key"))


def render_instincts(instincts: DataFrame) -> DataFrame:
    """Frontmatter text of each instinct: scalars quoted when they hold ``: # [ ]``,
    lists as ``[a, b]`` with items holding a comma quoted."""
    def scalar(c):
        s = F.coalesce(c.cast("string"), F.lit(""))
        return F.when(s.rlike(r"[:#\[\]]"), F.concat(F.lit('"'), s, F.lit('"'))).otherwise(s)
    d = lambda c: F.date_format(c, "yyyy-MM-dd")
    listed = F.col("projects") if "projects" in instincts.columns else F.array(F.lit("shared"))
    items = F.transform(listed, lambda x: F.when(x.contains(","), F.concat(F.lit('"'), x, F.lit('"'))).otherwise(x))
    text = F.concat_ws("\n",
                       F.lit("---"), F.concat(F.lit("id: "), scalar(F.col("key"))), F.lit("type: instinct"),
                       F.concat(F.lit("trigger: "), scalar(F.col("trigger"))),
                       F.concat(F.lit("action: "), scalar(F.col("action"))),
                       F.concat(F.lit("domain: "), scalar(F.col("domain"))),
                       F.concat(F.lit("confidence: "), py_float_text(F.col("confidence"))),
                       F.concat(F.lit("projects: ["), F.array_join(items, ", "), F.lit("]")),
                       F.concat(F.lit("source: "), scalar(F.col("source"))),
                       F.concat(F.lit("evidence_count: "), F.col("evidence_count").cast("string")),
                       F.concat(F.lit("created: "), d("created")), F.concat(F.lit("last_seen: "), d("last_seen")),
                       F.concat(F.lit("updated: "), d("updated")), F.lit("---"),
                       F.concat(F.lit("# "), title_from_id(F.col("key"))))
    return instincts.select("key", text.alias("text"))


INSTINCT_FRONTMATTER = r"(?s)\A---\n(.*?)\n---"


def parse_instinct_files(files: DataFrame) -> DataFrame:
    """Instinct rows (key, trigger, action, domain, confidence, source,
    evidence_count, created, last_seen, updated, projects) of the markdown files
    of the instincts layer (name, content).

    Each header line with a colon that is no comment is a pair, whatever its
    indent; values lose spaces and quotes, ``[a, b]`` is a list, the last
    duplicate wins. A file without a header, or without a pair in it, is no
    instinct. ``key`` is the ``id``, else the file's stem; numbers and dates that
    do not parse are null. Each file's header is parsed within its row."""
    head = F.regexp_extract("content", INSTINCT_FRONTMATTER, 1)
    lines = F.filter(py_lines(head), lambda x: x.contains(":") & ~py_strip(x).startswith("#"))
    pairs = F.transform(lines, lambda x: F.struct(py_strip(F.substring_index(x, ":", 1)).alias("k"),
                                                  strip_quotes(py_strip(F.substring(x, F.instr(x, ":") + 1, F.length(x)))).alias("v")))
    p = files.where(F.col("content").rlike(INSTINCT_FRONTMATTER)).select("name", pairs.alias("pairs")).where(F.size("pairs") > 0)

    def get(key):
        return F.try_element_at(F.filter("pairs", lambda x: x["k"] == key), F.lit(-1))["v"]
    listed = get("projects")
    is_list = listed.startswith("[") & listed.endswith("]")
    items = F.transform(F.filter(F.split(F.substring(listed, F.lit(2), F.length(listed) - 2), ",", -1), lambda x: py_strip(x) != ""),
                        lambda x: strip_quotes(py_strip(x)))
    return p.select(
        F.coalesce(F.nullif(get("id"), F.lit("")), F.regexp_replace("name", r"\.md$", "")).alias("key"),
        *[get(c).alias(c) for c in ("trigger", "action", "domain")], get("confidence").try_cast(CONF).alias("confidence"),
        get("source").alias("source"), get("evidence_count").try_cast("bigint").alias("evidence_count"),
        *[get(c).try_cast("date").alias(c) for c in ("created", "last_seen", "updated")],
        F.when(listed.isNotNull(), F.when(is_list, items).otherwise(F.array(listed))).alias("projects"))


# ── Clusters ──────────────────────────────────────────────────────────

CLUSTER_SCHEMA = ("struct<clusters: array<struct<canonical_id: string, duplicate_ids: array<string>, "
                  "merged_trigger: string, merged_action: string, merged_domain: string>>>")


def parse_cluster_json(responses: DataFrame, id_col: str = "response_id", text_col: str = "text") -> DataFrame:
    """Greedy first ``{`` to last ``}``, parsed; clusters listing at least two
    duplicate ids are kept: (response_id, cluster, canonical_id, duplicate_ids, merged_*)."""
    j = responses.select(F.col(id_col).alias("response_id"),
                         F.from_json(F.regexp_extract(F.col(text_col), JSON_OBJECT, 0), CLUSTER_SCHEMA).alias("j"))
    c = j.select("response_id", F.posexplode("j.clusters").alias("cluster", "c"))
    c = c.where(F.size("c.duplicate_ids") >= 2)
    return c.select("response_id", F.col("cluster").cast("bigint").alias("cluster"), "c.canonical_id",
                    "c.duplicate_ids", "c.merged_trigger", "c.merged_action", "c.merged_domain")


def merge_clusters(instincts: DataFrame, evidence: DataFrame, clusters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merge each valid cluster into its canonical instinct; returns (merged, deleted).

    Members = canonical + duplicates other than the canonical; a cluster with an
    unknown member or fewer than two members is skipped. Confidence = max, count =
    sum, projects = ordered distinct union (else ``[shared]``), created = min,
    last_seen = max, trigger/action/domain = merged value else the canonical's;
    evidence = distinct lines. The other members are deleted."""
    cl = clusters.withColumn("cid", F.concat_ws(":", F.col("response_id").cast("string"), F.col("cluster").cast("string")))
    mem = cl.select("cid", "canonical_id", F.posexplode(F.concat(
        F.array("canonical_id"), F.filter("duplicate_ids", lambda d: d != F.col("canonical_id")))).alias("m", "key"))
    known = mem.join(instincts.select("key", F.lit(True).alias("known")), "key", "left")
    ok = (known.groupBy("cid").agg(F.count(F.lit(1)).alias("n_members"),
                                   F.count(F.when(F.col("known").isNull(), 1)).alias("n_unknown"))
          .where((F.col("n_unknown") == 0) & (F.col("n_members") >= 2)))
    m = mem.join(ok.select("cid", "n_members"), "cid").join(instincts, "key")
    proj = m.select("cid", "m", F.posexplode(F.coalesce("projects", F.array().cast("array<string>"))).alias("p_pos", "p"))
    proj = (proj.where(F.col("p") != "").groupBy("cid", "p").agg(F.min(F.struct("m", "p_pos")).alias("o"))
            .groupBy("cid").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "p"))), lambda s: s["p"]).alias("projects")))
    agg = m.groupBy("cid", "canonical_id", "n_members").agg(
        F.max(F.coalesce(F.col("confidence").cast(CONF), F.lit(DEFAULT_CONFIDENCE).cast(CONF))).alias("confidence"),
        F.sum(F.coalesce(F.col("evidence_count").cast("bigint"), F.lit(1))).alias("evidence_count"),
        F.min("created").alias("created"), F.max("last_seen").alias("last_seen"),
        F.max(F.when(F.col("m") == 0, F.struct("trigger", "action", "domain", "source"))).alias("canon"))
    merged = (agg.join(cl.select("cid", "merged_trigger", "merged_action", "merged_domain"), "cid")
              .join(proj, "cid", "left")
              .select("cid", F.col("canonical_id").alias("key"), "n_members",
                      F.coalesce(F.nullif("merged_trigger", F.lit("")), F.col("canon.trigger")).alias("trigger"),
                      F.coalesce(F.nullif("merged_action", F.lit("")), F.col("canon.action")).alias("action"),
                      F.coalesce(F.nullif("merged_domain", F.lit("")), F.col("canon.domain"), F.lit("general")).alias("domain"),
                      "confidence", F.col("evidence_count").cast("bigint").alias("evidence_count"),
                      F.when(F.size("projects") > 0, F.col("projects")).otherwise(F.array(F.lit("shared"))).alias("projects"),
                      "created", "last_seen"))
    deleted = mem.join(ok.select("cid"), "cid").where(F.col("m") > 0).select("cid", "key")
    return merged, deleted


def merged_evidence(evidence: DataFrame, merged: DataFrame, deleted: DataFrame) -> DataFrame:
    """Distinct evidence lines of every cluster member, attached to the canonical."""
    members = merged.select("cid", F.col("key").alias("canonical")).join(
        deleted.select("cid", "key").unionByName(merged.select("cid", "key")), "cid")
    return (members.join(evidence, "key").groupBy(F.col("canonical").alias("key"), "line")
            .agg(F.min("ts").alias("ts")))



def extract_evidence(files: DataFrame, key: str = "key", content: str = "content") -> DataFrame:
    """Evidence lines of instinct files: trimmed lines starting ``- ``, each kept at
    its first position: (key, pos, line)."""
    ln = files.select(F.col(key).alias("key"), F.posexplode(py_lines(content)).alias("pos", "raw"))
    ln = ln.select("key", "pos", py_strip("raw").alias("line")).where(F.col("line").startswith("- "))
    return ln.groupBy("key", "line").agg(F.min("pos").alias("pos")).select("key", "pos", "line")
