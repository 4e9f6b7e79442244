"""Golden micro-vaults: expected values worked out by hand from the reference's
rules (frontmatter, projects, links, transcripts, throttle, instincts, clusters,
daily headers, secrets)."""

from pyspark.sql import functions as F

from lorekit.functions.text import py_lines, redact, slugify, word_count
from lorekit.operators import extract, lint
from lorekit.operators.extract import extract_frontmatter, extract_links, projects_field, split_body


def _files(spark, rows):
    return spark.createDataFrame(rows, "slug string, kind string, content string")


def _fm(spark, content):
    df = extract_frontmatter(_files(spark, [("a", "concepts", content)]))
    return {r["key"]: (r["is_list"], list(r["vals"])) for r in df.collect()}


def test_frontmatter_edge_cases(spark):
    assert _fm(spark, "---\ntitle: A\ntags: [x, 'y', \"z\", ]\n---\nbody") == {
        "title": (False, ["A"]), "tags": (True, ["x", "y", "z", ""])}
    # dash list, comments and blanks do not close it; duplicate key: last wins
    got = _fm(spark, "---\nsrc:\n  - a\n\n# c\n  - 'b'\nsrc: [q]\n---\n")
    assert got == {"src": (True, ["q"])}
    got = _fm(spark, "---\nsrc:\n  - a\n  - b\nk: v\n---\n")
    assert got == {"src": (True, ["a", "b"]), "k": (False, ["v"])}
    # empty value opens a list even if no item follows
    assert _fm(spark, "---\nk:\n---\n") == {"k": (True, [])}
    # BOM / leading blank → no frontmatter; ---- also closes the block
    assert _fm(spark, "\ufeff---\nk: v\n---\n") == {}
    assert _fm(spark, "---\nk: v\n----\n") == {"k": (False, ["v"])}
    assert _fm(spark, "---\n---\n") == {}
    assert _fm(spark, '---\nq: "quoted: x"\n---\n') == {"q": (False, ["quoted: x"])}


def test_body_and_words(spark):
    df = spark.createDataFrame([("---\nk: v\n---\n\n\none two\tthree\u00a0four",),
                                ("---\n# only comment\n---\nx y",)], "content string")
    rows = df.select(split_body("content").alias("b")).select("b", word_count("b").alias("n")).collect()
    assert rows[0]["b"] == "one two\tthree\u00a0four" and rows[0]["n"] == 4
    # a frontmatter that parses to nothing: the whole text is the body
    assert rows[1]["b"].startswith("---") and rows[1]["n"] == 7


def test_projects_field_dialect(spark):
    cases = [("---\nprojects: [a, B]\n---\n", ["a", "B"]), ("---\nprojects: []\n---\n", []),
             ("---\nprojects: [\"\"]\n---\n", [""]), ("---\ntitle: x\n---\n", None),
             ("---\nprojects:\n  - a\n---\n", None), ("---\ntitle: a---b\nprojects: [z]\n---\n", None),
             ("---\nprojects: [a,\n b]\n---\n", ["a", "b"])]
    df = spark.createDataFrame([(c,) for c, _ in cases], "content string")
    got = [r[0] for r in df.select(projects_field("content")).collect()]
    assert [None if g is None else list(g) for g in got] == [e for _, e in cases]


def test_links(spark):
    content = "---\nx: [[fm]]\n---\n[[a|Alias]] [[b#sec]] ![[img.png]] [[a]] [[c\nd]] [[[z]] [[ daily/2024-01-01 ]]"
    df = extract_links(_files(spark, [("s", "concepts", content)]))
    got = [(r["target"], r["is_daily"]) for r in df.orderBy("pos").collect()]
    assert got == [("fm", False), ("a", False), ("b#sec", False), ("img.png", False), ("a", False),
                   ("c\nd", False), ("[z", False), ("daily/2024-01-01", True)]


def test_broken_links_daily_rule(spark):
    arts = _files(spark, [("concepts/a", "concepts", "[[daily/2024-01-01]] [[daily/2024-01-01.md]] [[concepts/a]] [[nope]]")])
    links = extract_links(arts)
    dailies = spark.createDataFrame([("2024-01-01.md",)], "name string")
    out = lint.lint_broken_links(links, arts.select("slug"), dailies).orderBy("pos").collect()
    assert [r["detail"] for r in out] == ["Daily source [[daily/2024-01-01]] does not exist",
                                          "Wikilink [[nope]] points to a non-existent article"]


def test_orphans_and_backlinks(spark):
    arts = _files(spark, [("concepts/a", "concepts", "[[concepts/b]] [[concepts/a]]"),
                          ("concepts/b", "concepts", "x"), ("concepts/c", "concepts", "[[concepts/b]]")])
    a = extract.build_articles(arts)
    links = extract_links(a)
    orphans = {r["file"] for r in lint.lint_orphan_pages(a, links).collect()}
    assert orphans == {"concepts/c.md"}          # a links to itself, b is linked
    back = {(r["file"], r["detail"]) for r in lint.lint_missing_backlinks(a, links).collect()}
    assert back == {("concepts/b.md", "Target linked from [[concepts/a]] but does not link back"),
                    ("concepts/b.md", "Target linked from [[concepts/c]] but does not link back")}


def test_slugify_and_lines(spark):
    df = spark.createDataFrame([("  Hello, World__Да! ",), ("a\r\nb\x0bc\u2028d\n",), ("",)], "s string")
    rows = df.select(slugify("s").alias("g"), py_lines("s").alias("l")).collect()
    assert rows[0]["g"] == "hello-world-да"
    assert list(rows[1]["l"]) == ["a", "b", "c", "d"]
    assert list(rows[2]["l"]) == []


def test_redact(spark):
    df = spark.createDataFrame([("Authorization: Bearer abcdefghijkl",), ("api_key=12345678 and token='short'",),
                                ("nothing here",)], "s string")
    got = [r[0] for r in df.select(redact("s")).collect()]
    assert got == ["Authorization: Bearer [REDACTED]", "api_key=[REDACTED] and token='short'", "nothing here"]


def test_transcripts(spark):
    from lorekit.operators.transcripts import flatten_turns, session_context
    lines = [
        '{"message": {"role": "user", "content": "  hi  "}}',
        '{"message": {"role": "assistant", "content": [{"type": "text", "text": "a"}, "b", {"type": "tool_use"}]}}',
        'not json', '', '{"type": "x"}',
        '{"message": {"role": "system", "content": "s"}}',
        '{"message": "str", "role": "user", "content": "top"}',
        '{"message": {"role": "user", "content": [{"type": "text", "text": null}]}}',
        '{"message": {"role": "assistant", "content": "   "}}',
        '[1, 2]',
    ]
    df = spark.createDataFrame([("s1", i, l) for i, l in enumerate(lines)], "session_id string, seq int, line string")
    turns = flatten_turns(df).orderBy("seq").collect()
    assert [(r["role"], r["text"]) for r in turns] == [("user", "hi"), ("assistant", "a\nb"), ("user", "top")]
    ctx = session_context(flatten_turns(df), 30, 15000).collect()[0]
    assert ctx["n_turns"] == 3
    assert ctx["context"] == "**User:** hi\n\n**Assistant:** a\nb\n\n**User:** top\n"
    # over budget: keep the tail, then cut to the first "\n**" after position 0
    small = session_context(flatten_turns(df), 30, 20).collect()[0]["context"]
    assert small == "**User:** top\n"


def test_repair_json(spark):
    from lorekit.operators.transcripts import repair_json
    df = spark.createDataFrame([('{"p": "C:\\dir\\x"}',), ('{"ok": 1}',)], "s string")
    got = df.select(F.to_json(repair_json("s")).alias("j")).collect()
    assert got[0]["j"] == '{"p":"C:\\\\dir\\\\x"}' and got[1]["j"] == '{"ok":1}'


def test_throttle_golden(spark):
    from lorekit.operators.observations import throttle
    rows = [("k", i, f"2024-01-01 00:00:{s:02d}" if s < 60 else f"2024-01-01 00:01:{s - 60:02d}")
            for i, s in enumerate([0, 10, 29, 31, 45, 70])]
    df = spark.createDataFrame(rows, "k string, seq long, ts string").withColumn("ts", F.to_timestamp("ts"))
    got = sorted(r["seq"] for r in throttle(df, "k", 30).collect())
    assert got == [0, 3, 5]            # 0 s, 31 s, 70 s


def test_upsert_closed_form_matches_fold(spark):
    """Confidence after 1, 2, 7, 12 proposals starting at 0.3, 0.85, 0.95."""
    from decimal import Decimal
    from lorekit.operators.instincts import upsert_instincts
    rows = []
    for c0 in (0.3, 0.85, 0.95):
        for n in (1, 2, 7, 12):
            for j in range(n):
                rows.append((f"i-{c0}-{n}", "t", "a", None, c0 if j == 0 else 0.5, "e", j))
    df = spark.createDataFrame(rows, "id string, trigger string, action string, domain string, confidence double, "
                                     "evidence string, j int").withColumn(
        "ts", F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, j, 0, 0, 0)"))
    out, _ = upsert_instincts(None, df)
    got = {r["key"]: r["confidence"] for r in out.collect()}

    def fold(c0, n):
        c = round(c0, 2)
        for _ in range(n - 1):
            c = round(min(0.9, c + 0.1), 2)
        return Decimal(str(c)).quantize(Decimal("0.01"))
    for c0 in (0.3, 0.85, 0.95):
        for n in (1, 2, 7, 12):
            key = f"i-{c0}-{n}".replace(".", "")
            assert got[key] == fold(c0, n), (c0, n)


def test_clusters(spark):
    from lorekit.operators.instincts import merge_clusters, parse_cluster_json
    inst = spark.createDataFrame(
        [("a", "ta", "aa", "d", 0.5, "s", 2, "2024-01-01", "2024-01-05", ["p1"]),
         ("b", "tb", "ab", "d", 0.7, "s", 3, "2024-01-02", "2024-01-09", ["p2", "p1"]),
         ("c", "tc", "ac", "d", 0.4, "s", 1, "2024-01-03", "2024-01-04", [])],
        "key string, trigger string, action string, domain string, confidence double, source string, "
        "evidence_count int, created string, last_seen string, projects array<string>")
    text = ('noise {"clusters": [{"canonical_id": "a", "duplicate_ids": ["a", "b"], "merged_trigger": "T"},'
            '{"canonical_id": "a", "duplicate_ids": ["c"]},'
            '{"canonical_id": "b", "duplicate_ids": ["c", "zz"]}]} tail')
    resp = spark.createDataFrame([("r", text)], "response_id string, text string")
    c = parse_cluster_json(resp)
    assert c.count() == 2                      # a cluster listing one duplicate is dropped
    merged, deleted = merge_clusters(inst, None, c)
    m = merged.collect()
    assert len(m) == 1 and m[0]["key"] == "a" and m[0]["trigger"] == "T" and m[0]["action"] == "aa"
    assert float(m[0]["confidence"]) == 0.7 and m[0]["evidence_count"] == 5
    assert list(m[0]["projects"]) == ["p1", "p2"]
    assert [r["key"] for r in deleted.collect()] == ["b"]


def test_daily_headers(spark):
    from lorekit.operators.extract import extract_headers_scoped, extract_sections
    content = ("### Session (10:00) — alpha\n### Session (10:05) — Beta (3)\n### Session (10:10) — My Project\n"
               "### Session (10:20)\n### AgentShield Alert (11:00)\n### Session (10:00) — alpha\n"
               "### Session (12:00) — unknown-x\n")
    d = spark.createDataFrame([("d.md", content)], "name string, content string")
    reg = spark.createDataFrame([(1, "id1", "alpha", "Alpha", ["al"]), (2, "id2", "beta", "Beta", [])],
                                "ord int, id string, name string, canonical string, aliases array<string>")
    s = {(r["header"], r["project"], r["pos"]) for r in extract_sections(d, reg).collect()}
    assert s == {("Session (10:00) — alpha", "Alpha", 5), ("Session (10:05) — Beta (3)", "Beta", 1),
                 ("Session (12:00) — unknown-x", "unknown-x", 6)}
    h = [r["header_project"] for r in extract_headers_scoped(d).orderBy("pos").collect()]
    assert h == ["alpha", "Beta", None, None, None, "alpha", "unknown-x"]


def test_summarize_and_classify(spark):
    from lorekit.operators.observations import classify_tool_results, summarize_tool_events
    raw = spark.createDataFrame([
        ('{"command": "ls -la", "zeta": true, "files": [1, 2], "path": "/x", "n": 3, "nested": {"a": 1}}',
         '{"isError": true, "error": "boom"}'),
        ('{"prompt": "token=abcdefghijk"}', '"plain"'),
        ('{"url": "u"}', '{"error": ""}'),
    ], "i string, r string").select(F.parse_json("i").alias("tool_input"), F.parse_json("r").alias("tool_response"))
    s = summarize_tool_events(raw)
    c = classify_tool_results(s).collect()
    assert c[0]["input_summary"] == "path=/x command=ls -la n=3 zeta=True"   # unlisted lists are skipped
    assert c[1]["input_summary"] == "prompt=token=[REDACTED]"
    assert (c[0]["success"], c[0]["error"]) == (False, "boom")
    assert (c[1]["success"], c[1]["error"]) == (True, None)
    assert (c[2]["success"], c[2]["error"]) == (True, None)


def test_scan_and_parse_index(spark):
    from lorekit.operators.extract import parse_index_rows, scan_index
    idx = ("# Knowledge Base Index\n\n| Article | Summary | Projects | Compiled From | Updated |\n"
           "|---------|---------|----------|---------------|---------|\n"
           "| [[concepts/a]] | About A | alpha | daily/x.md | 2024-01-01 |   \n"
           "| [[concepts/b|B]] | About B |\n| no link here |\n")
    f = spark.createDataFrame([("index.md", idx)], "name string, content string")
    rows = parse_index_rows(scan_index(f)).orderBy("pos").collect()
    assert [r["slug"] for r in rows] == ["concepts/a", "concepts/b"]
    assert list(rows[0]["cells"]) == ["[[concepts/a]]", "About A", "alpha", "daily/x.md", "2024-01-01"]
    assert rows[0]["raw"].endswith("|")          # trailing whitespace stripped
    # a '|' inside a link shifts the cells, as in the reference
    assert list(rows[1]["cells"]) == ["[[concepts/b", "B]]", "About B"]
