"""Project attribution of articles: sources → dailies → sections → projects,
narrowed by alias mentions, inherited along links, then back-filled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekit.functions.text import basename, let, py_strip
from lorekit.operators.extract import alias_map_last_wins
from lorekit.operators.inheritance import given_lists
from lorekit.operators.inheritance import ordered_distinct_ci as _ordered_distinct_ci
from lorekit.session import cut_lineage

DEFAULT_PROJECT = "shared"


def attribute_articles(articles: DataFrame, sources: DataFrame, sections: DataFrame) -> DataFrame:
    """(slug, derived): distinct sorted canonical projects of the sections of the
    daily logs an article lists as ``daily/…`` sources (the file name is the
    source's base name)."""
    s = sources.where(F.col("source").startswith("daily/")).select("slug", basename("source").alias("name"))
    # one array per daily first, so a source brings one row, not one per project of its day
    per_daily = sections.join(s.select("name").distinct(), "name", "left_semi").groupBy("name").agg(F.collect_set("project").alias("projects"))
    d = s.distinct().join(per_daily, "name").groupBy("slug").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("projects")))).alias("derived"))
    return articles.select("slug").join(d, "slug", "left").select(
        "slug", F.coalesce("derived", F.array().cast("array<string>")).alias("derived"))


WORDS = r"(?U)(\w+)"


def narrow_by_mention(articles: DataFrame, derived: DataFrame, registry: DataFrame) -> DataFrame:
    """(slug, narrowed): with more than one candidate, keep those whose alias occurs
    as a whole word in the lower-cased body (sorted); none found → all candidates.
    Each body's words meet the words of the aliases, and only what meets leaves the scan of the bodies: an alias of
    word characters only is a whole word exactly if it is one of the body's words; any other alias has all its words
    among them, and those few pairs take a substring test, then a word-boundary regex."""
    look = alias_map_last_wins(registry, skip_shared=True).select(
        "alias_lc", "canonical", F.col("alias_lc").rlike(r"(?U)^\w+$").alias("plain"),
        F.array_distinct(F.regexp_extract_all("alias_lc", F.lit(WORDS), 1)).alias("parts"))
    body, version = F.lower("body"), F.xxhash64("body").alias("version")      # rows of one slug may differ in their text
    words = articles.select("slug", version, F.explode(F.regexp_extract_all(body, F.lit(WORDS), 1)).alias("part"))
    alias = ["alias_lc", "canonical", "plain"]
    met = (words.join(look.select(*alias, F.size("parts").alias("n"), F.explode("parts").alias("part")), "part")
           .groupBy("slug", "version", *alias, "n").agg(F.collect_set("part").alias("found")))
    met = cut_lineage(met.where(F.size("found") == F.col("n")).select("slug", "version", *alias))
    several = derived.where(F.size("derived") > 1)
    wordless = several.select("slug", F.explode("derived").alias("canonical")).join(
        look.where(F.size("parts") == 0).select("alias_lc", "canonical"), "canonical")
    unsure = cut_lineage(met.where(~F.col("plain")).select("slug", "canonical", "alias_lc")
                         .unionByName(wordless.select("slug", "canonical", "alias_lc")).distinct())
    pattern = F.concat(F.lit(r"(?U)\b\Q"), F.col("alias_lc"), F.lit(r"\E\b"))
    seen = unsure.join(articles.select("slug", version, body.alias("body_lc")), "slug").where(
        (F.instr("body_lc", F.col("alias_lc")) > 0) & F.regexp_like(F.col("body_lc"), pattern))
    hits = met.where("plain").select("slug", "version", "canonical").unionByName(seen.select("slug", "version", "canonical"))
    hits = hits.join(several.hint("merge"), "slug").where(F.array_contains("derived", F.col("canonical")))
    mentioned = hits.groupBy("slug", "version").agg(F.array_sort(F.collect_set("canonical")).alias("mentioned"))
    mentioned = mentioned.join(articles.select("slug", version), ["slug", "version"]).select("slug", "mentioned")
    out = derived.join(mentioned.hint("merge"), "slug", "left")
    return out.select("slug", F.when(F.size("derived") > 1, F.coalesce("mentioned", "derived"))
                      .otherwise(F.col("derived")).alias("narrowed"))


def inherit_projects(articles: DataFrame, links: DataFrame, donors: DataFrame) -> DataFrame:
    """(slug, inherited): projects of linked donor articles in link order,
    case-insensitive distinct, ``shared`` skipped. Links are read from the body
    (after the frontmatter); daily links are ignored."""
    body_links = (articles.select("slug", F.posexplode(F.regexp_extract_all("body", F.lit(r"\[\[([^\]]+)\]\]"), 1))
                                  .alias("pos", "raw"))
                  .select("slug", "pos", py_strip(F.substring_index("raw", "|", 1)).alias("target"))
                  .where(~F.col("target").startswith("daily/")))
    # lists stay whole in the joins, and no side is broadcast: a list that repeats is small on disk and large in memory
    d = donors.select(F.col("slug").alias("target"), "projects").where(F.size("projects") > 0)
    g = body_links.join(d.hint("merge"), "target").groupBy("slug").agg(F.collect_list(F.struct("pos", "projects")).alias("given"))
    placed = F.flatten(F.transform("given", lambda x: F.transform(x["projects"], lambda p, k: F.struct(x["pos"], k.alias("k"), p.alias("p")))))
    in_order = F.transform(F.array_sort(F.filter(placed, lambda x: F.lower(x["p"]) != "shared")), lambda x: x["p"])
    g = g.where(F.exists("given", lambda x: F.exists(x["projects"], lambda p: F.lower(p) != "shared")))
    return g.select("slug", _ordered_distinct_ci(in_order).alias("inherited"))


def backfill_projects(articles: DataFrame, derived: DataFrame, narrowed: DataFrame, links: DataFrame,
                      default: str = DEFAULT_PROJECT) -> DataFrame:
    """(slug, kind, existing, projects): articles whose ``projects`` field changes.

    union = existing ∪ (inherited or narrowed), case-insensitive, existing first;
    empty → [default]; emitted when the field is missing or the lower-cased sorted
    lists differ. Articles without frontmatter are skipped. One hop: concepts take
    no inherited projects; connections and qa inherit from changed concepts (the
    reference processes concepts first, so those are the donors it can see)."""
    a = articles.where(F.col("content").startswith("---") & (F.locate("\n---", F.col("content"), 4) > 0))
    base = a.select("slug", "kind", "projects").join(narrowed.hint("merge"), "slug", "left")

    def union(inh):
        cand = F.when(F.size(F.coalesce(inh, F.array().cast("array<string>"))) > 0, inh).otherwise(
            F.coalesce("narrowed", F.array().cast("array<string>")))
        u = _ordered_distinct_ci(F.concat(F.coalesce("projects", F.array().cast("array<string>")), cand))
        return let(u, lambda u: F.when(F.size(u) > 0, u).otherwise(F.array(F.lit(default))))

    def with_union(rows, inh):
        # written before the filter, which would else be pushed down and work every union out again
        return cut_lineage(rows.select("slug", "kind", "projects", union(inh).alias("u"))).where(changed(F.col("u")))

    def changed(u):
        old = F.array_sort(F.transform(F.coalesce("projects", F.array().cast("array<string>")), F.lower))
        return F.col("projects").isNull() | (old != F.array_sort(F.transform(u, F.lower)))

    concepts = with_union(base.where(F.col("kind") == "concepts"), F.lit(None).cast("array<string>"))
    donors = concepts.select("slug", F.col("u").alias("projects"))
    others = base.where(F.col("kind") != "concepts").join(
        inherit_projects(a.where(F.col("kind") != "concepts"), links, donors).hint("merge"), "slug", "left")
    others = with_union(others, F.col("inherited"))
    return concepts.unionByName(others).select("slug", "kind", F.col("projects").alias("existing"),
                                               F.col("u").alias("projects"))


KIND_ORDER = {"concepts": 0, "connections": 1, "qa": 2}


def with_projects_field(content: F.Column, projects: F.Column) -> F.Column:
    """``content`` with ``projects: [a, b]`` as the last line of its frontmatter, in place of any line of that name;
    a text without frontmatter stays as it is. The items of an old dash list are lines of their own and stay."""
    end = F.locate("\n---", content, 4)
    kept = F.filter(F.split(F.substring(content, F.lit(1), end - 1), "\n", -1), lambda line: ~line.startswith("projects:"))
    field = F.concat(F.lit("projects: ["), F.array_join(projects, ", "), F.lit("]"))
    new = F.concat(F.array_join(F.concat(kept, F.array(field)), "\n"), F.substring(content, end, F.length(content)))
    return F.when(content.startswith("---") & (end > 0), new).otherwise(content)


def backfill_projects_ordered(articles: DataFrame, narrowed: DataFrame, default: str = DEFAULT_PROJECT) -> DataFrame:
    """(slug, kind, existing, projects, content): ``backfill_projects`` with the reference's full order semantics and
    the rewritten article.

    Articles are processed concepts, then connections, then qa, each in name
    order; an article that changed becomes a donor for every later article that
    links to it, so inheritance follows chains. What each article hands on comes
    from ``inheritance.given_lists`` in logarithmically many rounds; one join then
    gives every union."""
    kind_ord = F.create_map(*[F.lit(x) for kv in KIND_ORDER.items() for x in kv])
    a = articles.where(F.col("content").startswith("---") & (F.locate("\n---", F.col("content"), 4) > 0))
    a = a.select("slug", "kind", kind_ord[F.col("kind")].alias("ko"), "projects", "body", "content")
    empty = F.array().cast("array<string>")
    existing, lowered = F.coalesce("projects", empty), lambda c: F.transform(c, F.lower)
    base = a.select("slug", "kind", "ko", "projects").join(narrowed.hint("merge"), "slug", "left").select(
        "slug", "kind", "ko", "projects", existing.alias("e"), lowered(existing).alias("s"), F.coalesce("narrowed", empty).alias("narrowed"))
    base = cut_lineage(base.withColumn("static", F.col("projects").isNull() | (F.size("e") == 0) | (F.size(F.array_distinct("s")) < F.size("s"))))
    links = (a.select("slug", "ko", F.posexplode(F.regexp_extract_all("body", F.lit(r"\[\[([^\]]+)\]\]"), 1)).alias("pos", "raw"))
             .select("slug", "ko", "pos", py_strip(F.substring_index("raw", "|", 1)).alias("target"))
             .where(~F.col("target").startswith("daily/")))
    tgt = base.select(F.col("slug").alias("target"), F.col("ko").alias("tko"))
    # only links to articles processed earlier can donate; no table that grows with the articles is broadcast
    edges = cut_lineage(links.join(tgt.hint("merge"), "target")
             .where((F.col("tko") < F.col("ko")) | ((F.col("tko") == F.col("ko")) & (F.col("target") < F.col("slug"))))
             .groupBy("slug", "target").agg(F.min("pos").alias("pos")))

    donors, _ = given_lists(base.select("slug", "e", "s", "narrowed", "static"), edges)
    inherited = edges.join(donors.where("gives").select(F.col("slug").alias("target"), "list").hint("merge"), "target").groupBy("slug").agg(
        F.array_sort(F.collect_list(F.struct("pos", "list"))).alias("given"))
    b = base.join(inherited.hint("merge"), "slug", "left")
    cand = F.when(F.col("given").isNull(), F.col("narrowed")).otherwise(F.flatten(F.transform("given", lambda x: x["list"])))
    u = let(_ordered_distinct_ci(F.concat("e", cand)), lambda u: F.when(F.size(u) > 0, u).otherwise(F.array(F.lit(default))))
    b = cut_lineage(b.select("slug", "kind", "projects", "s", u.alias("u")))          # before the filter, so that each union is worked out once
    changed = b.where(F.col("projects").isNull() | (F.array_sort("s") != F.array_sort(lowered(F.col("u"))))).select("slug", "kind", "projects", "u")
    return changed.hint("merge").join(a.select("slug", "content"), "slug").select(
        "slug", "kind", F.col("projects").alias("existing"), F.col("u").alias("projects"), with_projects_field(F.col("content"), F.col("u")).alias("content"))
