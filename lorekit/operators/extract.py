"""Structural extraction: markdown files → tables (links, frontmatter, sections).

Parsers are native regex / array expressions evaluated per row; the stateful
parts of the reference parsers (dash lists under a key) become window functions
over the exploded line table, never a per-row Python loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekit.functions.text import (
    DAILY_HEADER, FM_KEY_LINE, FRONTMATTER, FRONTMATTER_WITH_GAP, PROJECTS_FIELD, TAG_AT_END,
    TAG_BEFORE_PAREN, TAG_SUFFIX, WIKILINK, py_lines, py_lstrip, py_rstrip, py_strip, strip_quotes, word_count,
)

FM_KEY_LINE_U = "(?U)" + FM_KEY_LINE


# ── Links ─────────────────────────────────────────────────────────────

def extract_links(articles: DataFrame, src_col: str = "slug", content_col: str = "content") -> DataFrame:
    """Every ``[[target|label]]`` occurrence in the whole file (frontmatter and code
    included), in order: (src, pos, raw, target, is_daily). Duplicates are kept."""
    x = articles.select(
        F.col(src_col).alias("src"),
        F.posexplode(F.regexp_extract_all(F.col(content_col), F.lit(WIKILINK), 1)).alias("pos", "raw"))
    target = py_strip(F.substring_index("raw", "|", 1))
    return x.select("src", F.col("pos").cast("int").alias("pos"), "raw", target.alias("target"),
                    target.startswith("daily/").alias("is_daily"))


# ── Frontmatter, dialect 1 (generic) ──────────────────────────────────

def _typed(value: F.Column, ddl: str) -> F.Column:
    return value.cast(ddl)


FM_ENTRIES = "array<struct<pos: int, key: string, value: string, is_list: boolean, items: array<string>>>"


def extract_frontmatter(files: DataFrame, key_col: str = "slug") -> DataFrame:
    """Generic frontmatter as a long table (slug, key, pos, is_list, vals).

    Scalars are 1-element arrays. ``key:`` with an empty value opens a dash list;
    blank and ``#`` lines are skipped and do not close it; any other line closes
    it. Inline lists split on every comma. The last duplicate key wins.

    The header of a file is one bounded row, so its lines are folded within the
    row: nothing is shuffled."""
    fm = files.where(F.col("content").rlike(FRONTMATTER)).select(
        F.col(key_col).alias("slug"), py_lines(F.regexp_extract("content", FRONTMATTER, 1)).alias("lines"))
    kept = F.filter(F.transform("lines", lambda line, i: F.struct(i.alias("pos"), line.alias("line"))),
                    lambda x: (py_strip(x["line"]) != "") & ~py_lstrip(x["line"]).startswith("#"))

    def step(acc, x):
        line, open_, none = x["line"], F.try_element_at(acc, F.lit(-1)), F.array().cast("array<string>")
        value = py_strip(F.regexp_extract(line, FM_KEY_LINE_U, 2))
        is_key = line.rlike(FM_KEY_LINE_U)
        entry = F.struct(x["pos"].alias("pos"), F.when(is_key, F.regexp_extract(line, FM_KEY_LINE_U, 1)).alias("key"), value.alias("value"),
                         (is_key & (value == "")).alias("is_list"), none.alias("items"))
        item = strip_quotes(py_strip(F.substring(py_lstrip(line), 3, 1 << 30)))
        longer = F.struct(*[open_[c].alias(c) for c in ("pos", "key", "value", "is_list")], F.concat(open_["items"], F.array(item)).alias("items"))
        grown = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(longer))
        return _typed(F.when(~py_lstrip(line).startswith("- "), F.concat(acc, F.array(entry)))
                      .when(F.coalesce(open_["is_list"], F.lit(False)), grown).otherwise(acc), FM_ENTRIES)

    entries = fm.select("slug", F.filter(F.aggregate(kept, _typed(F.array(), FM_ENTRIES), step), lambda e: e["key"].isNotNull()).alias("es"))
    last = F.filter("es", lambda e, i: ~F.exists(F.slice("es", i + 2, F.size("es")), lambda f: f["key"] == e["key"]))
    e = entries.select("slug", F.explode(last).alias("e")).select("slug", "e.*")
    v = F.col("value")
    inner = py_strip(F.regexp_extract(v, r"(?s)^\[(.*)\]$", 1))
    inline = v.rlike(r"(?s)^\[.*\]$")
    vals = (
        F.when(F.col("is_list"), F.col("items"))
        .when(inline, F.when(inner == "", F.array().cast("array<string>"))
              .otherwise(F.transform(F.split(inner, ",", -1), lambda s: strip_quotes(py_strip(s)))))
        .when((v.startswith('"') & v.endswith('"')) | (v.startswith("'") & v.endswith("'")),
              F.array(F.substring(v, F.lit(2), F.greatest(F.length(v) - 2, F.lit(0)))))
        .otherwise(F.array(v))
    )
    return e.select("slug", "key", "pos", (F.col("is_list") | inline).alias("is_list"), vals.alias("vals"))


def split_body(content) -> "F.Column":
    """Body after the frontmatter with leading LFs dropped; the whole text when the
    frontmatter parses to an empty map (no key line in it)."""
    c = F.col(content) if isinstance(content, str) else content
    block = F.regexp_extract(c, FRONTMATTER, 1)
    has_keys = c.rlike(FRONTMATTER) & F.exists(py_lines(block), lambda l: l.rlike(FM_KEY_LINE_U))
    return F.when(has_keys, F.regexp_replace(c, FRONTMATTER_WITH_GAP, "")).otherwise(c)


# ── Frontmatter, dialect 2 (projects field) ───────────────────────────

def projects_field(content) -> "F.Column":
    """``projects: [...]`` searched in content[3:find('---', 3)]: NULL when missing,
    [] when present but blank; bracket text may span lines."""
    c = F.col(content) if isinstance(content, str) else content
    end = F.locate("---", c, 4)
    fm = F.substring(c, F.lit(4), end - 4)
    pat = "(?d)" + PROJECTS_FIELD
    raw = py_strip(F.regexp_extract(fm, pat, 1))
    found = c.startswith("---") & (end > 0) & fm.rlike(pat)
    return (F.when(~found, F.lit(None).cast("array<string>"))
            .when(raw == "", F.array().cast("array<string>"))
            .otherwise(F.transform(F.split(raw, ",", -1), lambda s: strip_quotes(py_strip(s)))))


# ── Frontmatter, dialect 5 (sources for attribution) ──────────────────

SOURCE_FOLD = "struct<open: boolean, out: array<struct<line: bigint, k: bigint, source: string>>>"


def extract_sources(articles: DataFrame) -> DataFrame:
    """``sources`` as inline or dash list inside content[3:find('\\n---', 3)]:
    (slug, line, k, source). A block ends at the first non-blank line that is not
    indented. The header's lines are folded within the row; nothing is shuffled."""
    c = F.col("content")
    end = F.locate("\n---", c, 4)
    fm = articles.where(c.startswith("---") & (end > 0)).select("slug", py_lines(F.substring(c, F.lit(4), end - 4)).alias("lines"))
    lines = F.transform("lines", lambda line, i: F.struct(i.cast("bigint").alias("pos"), line.alias("line")))

    def step(acc, x):
        line, pos = x["line"], x["pos"]
        is_head, is_item = line.startswith("sources:"), py_strip(line).startswith("- ")
        after = py_strip(F.substring_index(F.substring(line, 9, 1 << 30), "\n", 1))
        inline = F.transform(F.regexp_extract_all(after, F.lit("['\"]?([^,\\[\\]'\"]+)['\"]?"), F.lit(1)),
                             lambda s, k: F.struct(pos.alias("line"), k.cast("bigint").alias("k"), py_strip(s).alias("source")))
        item = strip_quotes(py_strip(F.substring(py_strip(line), 3, 1 << 30)))
        block = F.array(F.struct(pos.alias("line"), F.lit(0).cast("bigint").alias("k"), item.alias("source")))
        out = (F.when(is_head & after.startswith("["), F.concat(acc["out"], inline))
               .when(acc["open"] & ~is_head & is_item, F.concat(acc["out"], block)).otherwise(acc["out"]))
        closes = (line != "") & ~line.startswith(" ") & ~line.startswith("\t") & ~is_item
        now = F.when(is_head, ~after.startswith("[")).when(closes, F.lit(False)).otherwise(acc["open"])
        return _typed(F.struct(now.alias("open"), out.alias("out")), SOURCE_FOLD)

    zero = _typed(F.struct(F.lit(False).alias("open"), F.array().alias("out")), SOURCE_FOLD)
    found = fm.select("slug", F.explode(F.aggregate(lines, zero, step)["out"]).alias("s")).select("slug", "s.*")
    return found.where(F.col("source") != "")


# ── Articles ──────────────────────────────────────────────────────────

def build_articles(files: DataFrame) -> DataFrame:
    """(slug, kind, content, projects, body, n_words) for concepts/connections/qa."""
    a = files.where(F.col("kind").isin("concepts", "connections", "qa"))
    body = split_body("content")
    return a.select("slug", "kind", "content", projects_field("content").alias("projects"),
                    body.alias("body")).withColumn("n_words", word_count("body"))


# ── Daily logs ────────────────────────────────────────────────────────

def daily_lines(dailies: DataFrame) -> DataFrame:
    return dailies.select("name", F.posexplode(py_lines("content")).alias("pos", "line"))


def alias_map_last_wins(registry: DataFrame, skip_shared: bool = False) -> DataFrame:
    """alias_lc → canonical, later registry entries overriding earlier ones
    (dict-assignment order: canonical, aliases, name); entries without canonical skipped."""
    r = registry.where(F.col("canonical").isNotNull() & (F.col("canonical") != ""))
    if skip_shared:
        r = r.where(F.col("canonical") != "Shared")
    names = F.concat(F.array(F.col("canonical")), F.coalesce("aliases", F.array().cast("array<string>")),
                     F.when(F.col("name").isNotNull() & (F.col("name") != ""), F.array("name"))
                     .otherwise(F.array().cast("array<string>")))
    e = r.select("ord", "canonical", F.posexplode(names).alias("k", "alias"))
    e = e.select(F.lower("alias").alias("alias_lc"), "canonical", "ord", "k")
    return e.groupBy("alias_lc").agg(F.max_by("canonical", F.struct("ord", "k")).alias("canonical"))


def extract_sections(dailies: DataFrame, registry: DataFrame) -> DataFrame:
    """Tagged ``### `` headers of each daily: (name, header, tag, project, pos).
    Untagged headers are dropped, unknown tags pass through, the same header twice
    keeps the last one."""
    lines = daily_lines(dailies).where(F.col("line").rlike(DAILY_HEADER))
    h = lines.select("name", "pos", F.regexp_extract("line", DAILY_HEADER, 1).alias("header"))
    h = h.select("name", "pos", "header", F.regexp_extract("header", TAG_SUFFIX, 1).alias("tag")).where("tag <> ''")
    amap = alias_map_last_wins(registry)
    j = h.join(amap, F.lower(h["tag"]) == amap["alias_lc"], "left")
    j = j.select("name", "pos", "header", "tag", F.coalesce("canonical", "tag").alias("project"))
    last = j.groupBy("name", "header").agg(F.max_by(F.struct("pos", "tag", "project"), "pos").alias("s"))
    return last.select("name", "header", F.col("s.tag").alias("tag"), F.col("s.project").alias("project"),
                       F.col("s.pos").alias("pos"))


def extract_headers_scoped(dailies: DataFrame) -> DataFrame:
    """Every line starting ``### `` with the digest's tag rule: tag at end of line,
    else a legacy tag before ``(``; NULL when untagged (matches every project)."""
    lines = daily_lines(dailies).where(F.col("line").startswith("### "))
    s = F.regexp_replace("line", r"\s+$", "")
    t1 = F.regexp_extract(s, TAG_AT_END, 1)
    t2 = F.regexp_extract(s, TAG_BEFORE_PAREN, 1)
    tag = F.when(t1 != "", t1).when(t2 != "", t2)
    return lines.select("name", "pos", "line", tag.alias("header_project"))


# ── Index rows ────────────────────────────────────────────────────────

def scan_index(index_files: DataFrame) -> DataFrame:
    """Rows of an index file: lines starting ``|`` that contain ``[[``."""
    lines = index_files.select("name", F.posexplode(py_lines("content")).alias("pos", "raw"))
    lines = lines.select("name", "pos", py_rstrip("raw").alias("raw"))
    return lines.where(F.col("raw").startswith("|") & F.col("raw").contains("[["))


def parse_index_rows(index_rows: DataFrame) -> DataFrame:
    """Cells of each row: strip the outer pipes, split on ``|``, trim; first link's slug."""
    body = F.regexp_replace(py_strip("raw"), r"^\|+|\|+$", "")
    cells = F.transform(F.split(body, r"\|", -1), lambda x: py_strip(x))
    link = F.regexp_extract("raw", WIKILINK, 1)
    return index_rows.select(
        "name", "pos", "raw", cells.alias("cells"),
        F.when(link != "", F.substring_index(link, "|", 1)).alias("slug"))
