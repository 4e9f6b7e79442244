"""Session digest, knowledge bundle, budgets and Q&A file-back.

Text that the reference builds as one string is produced here as ordered rows
with a running character count, so a large vault never becomes one value on
one task; the final string is only a concatenation of already-cut rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekit.functions.text import py_strip, slugify
from lorekit.session import cut_lineage

# ── Fixed values (digest layout and messages of the reference) ────────
DIGEST_BUDGET = 20_000
OTHER_ROWS_CAP = 40
SEPARATOR = "\n\n---\n\n"
TRUNCATED = "\n\n...(truncated)"
H_TODAY = "## Today\n"
H_PROJECT = "## Current Project\n\n"
H_CURRENT = "## Knowledge: Current + Shared\n\n"
H_OTHER = "## Knowledge: Other Projects (заголовки, читай по запросу)\n\n"
OTHER_TAIL = "  _(+ ещё {} — см. `knowledge/index.md`)_"   # follows the capped rows on its own line
H_INSTINCTS = "## Instincts (поведенческие паттерны, глобально)\n\n"
INSTINCTS_HEAD = "| Trigger | Action | Domain | Conf | Last Seen |\n|---------|--------|--------|------|-----------|"
INSTINCTS_EMPTY = "_(пока пусто — накапливаются из tool-событий текущих сессий)_"
INSTINCTS_NONE = "_(нет instincts с confidence >= 0.5)_"
H_WIKI = "## Wiki (внешние источники)\n\n"
WIKI_LINE = "_({} страниц во `{}` — открой через `Read` при необходимости)_"
WIKI_REL = "data/index.md"
H_DAILY = "## Daily Log (pointer)\n\n"
DAILY_SOME = "{}: `{}` ({} сессий по проекту, последняя — {}). Открой через `Read` для полного контекста."
DAILY_NONE = "{}: `{}` — нет сессий по текущему проекту."
DAILY_MISSING = "_(нет daily-логов за сегодня/вчера)_"
DAILY_LABELS = {"today": "сегодня", "yesterday": "вчера"}
BUNDLE_HEAD = "## INDEX\n\n"
KIND_ORDER = ("concepts", "connections", "qa")
QA_SLUG_CAP = 80
INDEX_HEADER = ("# Knowledge Base Index\n\n| Article | Summary | Projects | Compiled From | Updated |\n"
                "|---------|---------|----------|---------------|---------|\n")


def _fmt(template: str, *cols) -> F.Column:
    parts = template.split("{}")
    out = [F.lit(parts[0])]
    for c, p in zip(cols, parts[1:]):
        out += [c if isinstance(c, F.Column) else F.lit(str(c)), F.lit(p)]
    return F.concat(*out)


def compact_row(raw) -> F.Column:
    """``| [[link]] | summary | projects | … |`` → ``- [[link]] — summary _(projects)_``;
    fewer than two cells → the line as is."""
    r = F.col(raw) if isinstance(raw, str) else raw
    body = F.regexp_replace(py_strip(r), r"^\|+|\|+$", "")
    cells = F.transform(F.split(body, r"\|", -1), lambda x: py_strip(x))
    proj = F.when(F.size(cells) > 2, F.element_at(cells, 3)).otherwise(F.lit(""))
    suffix = F.when((proj != "") & ~proj.isin("-", "shared"), F.concat(F.lit(" _("), proj, F.lit(")_"))).otherwise(F.lit(""))
    return F.when(F.size(cells) < 2, r).otherwise(
        F.concat(F.lit("- "), F.element_at(cells, 1), F.lit(" — "), F.element_at(cells, 2), suffix))


def char_budget(rows: DataFrame, order: list[str], size: int, text: str = "text", key: list[str] | None = None) -> DataFrame:
    """Head cut of ordered text rows at ``size`` characters (per ``key`` group):
    rows wholly inside stay, the crossing row is cut, the rest are dropped. The
    row set is bounded by the caller (top-k before the budget), so the running sum
    runs over at most budget-many rows."""
    w = Window.partitionBy(*(key or [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    r = rows.withColumn("_end", F.sum(F.length(text)).over(w))
    r = r.withColumn("_start", F.col("_end") - F.length(text))
    r = r.where(F.col("_start") < size).withColumn(
        text, F.when(F.col("_end") > size, F.expr(f"substring({text}, 1, {size} - _start)")).otherwise(F.col(text)))
    return r.drop("_end", "_start")


def other_rows_capped(others: DataFrame, cap: int = OTHER_ROWS_CAP) -> DataFrame:
    """First ``cap`` rows in index order (indented) plus an overflow line; the
    top-k is a bounded heap, the count a plain aggregate."""
    first = others.orderBy("pos").limit(cap).select("pos", F.concat(F.lit("  "), compact_row("raw")).alias("line"))
    n = others.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cap)
    tail = n.select(F.lit(1 << 62).cast("long").alias("pos"), _fmt(OTHER_TAIL, (F.col("n") - cap).cast("string")).alias("line"))
    return first.unionByName(tail)


def session_digest(scoped: DataFrame, project: DataFrame,
                   instincts: DataFrame, wiki_lines: DataFrame, pointer: DataFrame, as_of: str,
                   budget: int = DIGEST_BUDGET) -> DataFrame:
    """The tiered session context for one project as ordered rows (part, pos, text),
    cut to ``budget`` characters with a truncation marker.

    ``scoped`` holds (pos, raw, scope) for the project (see ``classify_scope``);
    ``project`` is its one registry row (canonical, id)."""
    from lorekit.operators.instincts import top_instincts
    spark = scoped.sparkSession
    # every row but a list's first begins with a line break, so budget + 2 rows of a list always hold more than
    # the budget: no later row can be shown, and the size of these alone tells that the digest is cut
    max_rows = budget + 2
    cur = (scoped.where(F.col("scope").isin("current", "shared")).orderBy("pos").limit(max_rows)
           .select("pos", compact_row("raw").alias("line")))
    oth = other_rows_capped(scoped.where(F.col("scope") == "other"))
    top = top_instincts(instincts).limit(max_rows)
    inst = top.withColumn("pos", F.row_number().over(
        Window.orderBy(F.col("confidence").desc(), F.col("last_seen").asc(), F.col("key")))).select("pos", "line")
    n_top = top.agg(F.count(F.lit(1))).scalar()
    n_all = instincts.agg(F.count(F.lit(1))).scalar()

    def lines_part(part: int, df: DataFrame, head: str) -> DataFrame:
        w = Window.orderBy("pos")
        body = df.withColumn("_r", F.row_number().over(w)).select(
            F.lit(part).alias("part"), F.col("_r").cast("long").alias("pos"),
            F.when(F.col("_r") == 1, F.col("line")).otherwise(F.concat(F.lit("\n"), F.col("line"))).alias("text"))
        h = spark.createDataFrame([(part, 0, SEPARATOR + head)], "part int, pos long, text string")
        return h.unionByName(body)

    today = spark.createDataFrame([(0, 0, H_TODAY)], "part int, pos long, text string").select(
        "part", "pos", F.concat(F.col("text"), F.date_format(F.lit(as_of).cast("timestamp"), "dd.MM.yyyy (EEEE)")).alias("text"))
    proj = project.select(F.lit(1).alias("part"), F.lit(0).cast("long").alias("pos"), F.concat(
        F.lit(SEPARATOR + H_PROJECT + "**"), F.col("canonical"), F.lit("** (id: `"), F.col("id"), F.lit("`)")).alias("text"))
    parts = [today, proj, lines_part(2, cur, H_CURRENT)]
    parts.append(lines_part(3, oth, H_OTHER).where(oth.agg(F.count(F.lit(1))).scalar() > 0))
    inst_rows = inst.select("pos", "line")
    inst_block = spark.createDataFrame([(4, 0, SEPARATOR + H_INSTINCTS + INSTINCTS_HEAD)], "part int, pos long, text string")
    inst_lines = inst_rows.select(F.lit(4).alias("part"), F.col("pos").cast("long"), F.concat(F.lit("\n"), "line").alias("text"))
    empty = spark.createDataFrame([(4, 0)], "part int, pos long").select(
        "part", "pos", F.concat(F.lit(SEPARATOR + H_INSTINCTS), F.when(n_all == 0, F.lit(INSTINCTS_EMPTY))
                                .otherwise(F.lit(INSTINCTS_NONE))).alias("text")).where(n_top == 0)
    parts += [inst_block.where(n_top > 0), inst_lines, empty]
    wiki_n = wiki_lines.where(py_strip("line").startswith("- [[")).agg(F.count(F.lit(1)).alias("n"))
    parts.append(wiki_n.select(F.lit(5).alias("part"), F.lit(0).cast("long").alias("pos"),
                               F.concat(F.lit(SEPARATOR + H_WIKI), _fmt(WIKI_LINE, F.col("n").cast("string"), WIKI_REL)).alias("text")))
    p = pointer.select(F.lit(6).alias("part"), F.lit(0).cast("long").alias("pos"), F.concat(
        F.lit(SEPARATOR + H_DAILY),
        F.when(F.col("n_sessions") > 0, _fmt(DAILY_SOME, F.col("label_text"), F.concat(F.lit("daily/"), F.col("name")),
                                              F.col("n_sessions").cast("string"), F.col("last_header")))
        .otherwise(_fmt(DAILY_NONE, F.col("label_text"), F.concat(F.lit("daily/"), F.col("name"))))).alias("text"))
    missing = pointer.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(
        F.lit(6).alias("part"), F.lit(0).cast("long").alias("pos"), F.lit(SEPARATOR + H_DAILY + DAILY_MISSING).alias("text"))
    parts += [p, missing]
    rows = parts[0]
    for q in parts[1:]:
        rows = rows.unionByName(q)
    rows = cut_lineage(rows)
    total = rows.agg(F.sum(F.length("text")).alias("t"))
    cut = char_budget(rows, ["part", "pos"], budget)
    marker = total.where(F.col("t") > budget).select(F.lit(9).alias("part"), F.lit(0).cast("long").alias("pos"),
                                                     F.lit(TRUNCATED).alias("text"))
    return cut.unionByName(marker)


def knowledge_bundle(index_rows: DataFrame, articles: DataFrame) -> DataFrame:
    """The Q&A context as rows (kind_ord, slug, n_chars, cum_chars): the index part,
    then each kept article ``## <slug>.md\\n\\n<content>`` in kind then name order,
    parts separated by ``\\n\\n---\\n\\n``. The running size is computed within
    range partitions of the names plus the totals of the earlier partitions, so no
    window pulls the bundle into one task."""
    idx = index_rows.agg((F.coalesce(F.sum(F.length("raw") + 1), F.lit(0)) + len(BUNDLE_HEAD) + len(INDEX_HEADER))
                         .cast("long").alias("n_chars")).select(F.lit(0).alias("kind_ord"), F.lit("").alias("slug"), "n_chars")
    kind_ord = F.array_position(F.array(*[F.lit(k) for k in KIND_ORDER]), F.col("kind"))
    a = articles.select(kind_ord.alias("kind_ord"), "slug",
                        (F.length(F.concat(F.lit("## "), F.col("slug"), F.lit(".md\n\n"), F.col("content")))
                         + len(SEPARATOR)).cast("long").alias("n_chars"))
    parts = cut_lineage(idx.unionByName(a).repartitionByRange("kind_ord", "slug").withColumn("bucket", F.spark_partition_id()))
    inb = parts.withColumn("c", F.sum("n_chars").over(
        Window.partitionBy("bucket").orderBy("kind_ord", "slug").rowsBetween(Window.unboundedPreceding, 0)))
    tot = parts.groupBy("bucket").agg(F.sum("n_chars").alias("bt"))
    offs = tot.withColumn("off", F.coalesce(F.sum("bt").over(
        Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("bucket", "off")
    return (inb.join(F.broadcast(offs), "bucket")      # one row a partition
            .select("kind_ord", "slug", "n_chars", (F.col("off") + F.col("c")).cast("long").alias("cum_chars")))


def qa_slug(question) -> F.Column:
    s = F.substring(slugify(question), 1, QA_SLUG_CAP)
    return s


def file_back_qa(qa: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(articles, log): per slug the last write (by ts) becomes ``qa/<slug>`` text;
    every write appends a build-log entry."""
    q = qa.select("question", "answer", "ts", qa_slug(F.col("question")).alias("slug"))
    q = q.withColumn("slug", F.when(F.col("slug") != "", F.col("slug")).otherwise(
        F.concat(F.lit("q-"), F.date_format("ts", "HHmmss"))))
    last = q.groupBy("slug").agg(F.max(F.struct("ts", "question", "answer")).alias("w"))
    d = F.date_format("w.ts", "yyyy-MM-dd")
    text = F.concat(
        F.lit("---\ntitle: \"Q: "), F.col("w.question"), F.lit("\"\nquestion: \""),
        F.replace(F.col("w.question"), F.lit('"'), F.lit("'")), F.lit("\"\nfiled: "), d, F.lit("\ncreated: "), d,
        F.lit("\nupdated: "), d, F.lit("\nprojects: [shared]\n---\n\n# Q: "), F.col("w.question"),
        F.lit("\n\n## Answer\n\n"), F.col("w.answer"), F.lit("\n"))
    arts = last.select(F.concat(F.lit("qa/"), F.col("slug")).alias("slug"), text.alias("content"))
    log = q.select("ts", F.concat(F.lit("\n## ["), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("] query | "),
                                  F.col("question"), F.lit("\n- Filed to: [[qa/"), F.col("slug"), F.lit("]]\n")).alias("entry"))
    return arts, log


def wiki_page_count(lines: DataFrame) -> DataFrame:
    return lines.where(py_strip("line").startswith("- [[")).agg(F.count(F.lit(1)).alias("n_pages"))

