"""File sources and sinks on small hand-written fixtures."""

import json
import os

from pyspark.sql import functions as F

from lorekit.sources import scan


def _w(path, data: bytes | str):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data.encode() if isinstance(data, str) else data)


def test_scan_vault_hash_over_raw_bytes(spark, tmp_dir):
    root = os.path.join(tmp_dir, "data")
    crlf = b"---\r\ntitle: A\r\n---\r\nbody\r\n"
    _w(f"{root}/knowledge/concepts/a.md", crlf)
    _w(f"{root}/knowledge/concepts/b.txt", "ignored")
    _w(f"{root}/knowledge/concepts/sub/c.md", "not listed: non-recursive")
    _w(f"{root}/daily/2024-01-01.md", "# Daily Log: 01.01.2024\n")
    v = scan.scan_vault(spark, root, layers=("daily", "knowledge/concepts"))
    rows = {r["slug"]: r for r in v.collect()}
    assert set(rows) == {"concepts/a", "daily/2024-01-01"}
    import hashlib
    assert rows["concepts/a"]["sha16"] == hashlib.sha256(crlf).hexdigest()[:16]
    assert rows["concepts/a"]["content"] == "---\ntitle: A\n---\nbody\n"
    assert rows["daily/2024-01-01"]["name"] == "2024-01-01.md"


def test_scan_observations_drops_bad_lines(spark, tmp_dir):
    p = os.path.join(tmp_dir, "obs.jsonl")
    _w(p, "\n".join([
        json.dumps({"ts": "2024-01-01T10:00:00Z", "session_id": "s", "event": "pre", "tool": "Bash", "tool_call_num": 1}),
        "{not json",
        json.dumps({"ts": "yesterday", "session_id": "s", "event": "pre"}),
        json.dumps({"ts": "2024-01-01T10:00:05Z", "session_id": "s", "event": "post", "tool": "Bash", "success": False,
                    "error": "boom"}),
    ]) + "\n")
    o = scan.scan_observations(spark, p).orderBy("ts").collect()
    assert [(r["event"], r["success"], r["error"]) for r in o] == [("pre", None, None), ("post", False, "boom")]
    assert str(o[0]["ts"]) == "2024-01-01 10:00:00"


def test_scan_registry_and_state(spark, tmp_dir):
    reg = {"shared": {"id": "shared", "name": "shared", "canonical": "Shared", "aliases": ["shared", "all"]},
           "abc": {"id": "abc", "name": "proj", "canonical": "Proj", "aliases": ["proj", "p"], "root": "/r"}}
    _w(os.path.join(tmp_dir, "projects.json"), json.dumps(reg))
    r = scan.scan_registry(spark, os.path.join(tmp_dir, "projects.json")).orderBy("ord").collect()
    assert [(x["ord"], x["id"], x["canonical"]) for x in r] == [(0, "shared", "Shared"), (1, "abc", "Proj")]
    _w(os.path.join(tmp_dir, "bad.json"), "{oops")
    assert scan.scan_registry(spark, os.path.join(tmp_dir, "bad.json")).count() == 0
    st = {"ingested": {"a.md": {"hash": "0123456789abcdef", "compiled_at": "x"}, "b.md": "legacy"}, "query_count": 0}
    _w(os.path.join(tmp_dir, "state.json"), json.dumps(st))
    s = {x["name"]: x["hash"] for x in scan.scan_compile_state(spark, os.path.join(tmp_dir, "state.json")).collect()}
    assert s == {"a.md": "0123456789abcdef", "b.md": None}


def test_build_log_and_findings(spark, tmp_dir):
    log = ("# Build Log\n\n## [2024-01-02T10:00:00] compile | 2024-01-01.md\n- Source: daily/2024-01-01.md\n\n"
           "## [2024-01-02T11:00:00] query | What is X?\n- Filed to: [[qa/what-is-x]]\n")
    files = spark.createDataFrame([("log.md", log)], "name string, content string")
    b = scan.scan_build_log(files).orderBy("pos").collect()
    assert [(x["op"], x["description"], list(x["details"])) for x in b] == [
        ("compile", "2024-01-01.md", ["Source: daily/2024-01-01.md"]),
        ("query", "What is X?", ["Filed to: [[qa/what-is-x]]"])]
    rep = {"findings": [{"file": "a", "line": 3, "title": "t", "category": "c", "severity": "critical"},
                        {"file": "b", "title": "u", "category": "c"}]}
    _w(os.path.join(tmp_dir, "reports", "r1.json"), json.dumps(rep))
    f = scan.scan_findings(spark, os.path.join(tmp_dir, "reports")).orderBy("idx").collect()
    assert [(x["file"], x["line"], x["severity"]) for x in f] == [("a", 3, "critical"), ("b", None, None)]


def test_write_issues_and_versions(spark, tmp_dir):
    iss = spark.createDataFrame([("error", "broken_link", "a.md", "d", 0)], "severity string, check string, file string, detail string, pos int")
    scan.write_issues(iss, os.path.join(tmp_dir, "iss"))
    assert spark.read.json(os.path.join(tmp_dir, "iss")).count() == 1
    cur = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    ch = spark.createDataFrame([("b", 20), ("c", 30)], "id string, v int")
    p = scan.write_version(scan.upsert_by_key(cur, ch, ["id"]), os.path.join(tmp_dir, "t"), 1)
    assert sorted(map(tuple, spark.read.parquet(p).collect())) == [("a", 1), ("b", 20), ("c", 30)]


def test_parse_issue_json_and_evidence(spark):
    from lorekit.operators.instincts import extract_evidence
    from lorekit.operators.lint import parse_issue_json
    r = spark.createDataFrame([('Here: [{"file": "a.md", "detail": "x"}, 3, {"detail": "y"}, {}] end',), ("none",)], "text string")
    got = [(x["file"], x["detail"]) for x in parse_issue_json(r).orderBy("pos").collect()]
    assert got == [("a.md", "x"), ("?", "y"), ("?", "conflicting claim")]
    f = spark.createDataFrame([("k", "# T\n\n## Evidence\n\n- 2024-01-01: a\n  - 2024-01-02: b\n- 2024-01-01: a\n")],
                              "key string, content string")
    ev = [x["line"] for x in extract_evidence(f).orderBy("pos").collect()]
    assert ev == ["- 2024-01-01: a", "- 2024-01-02: b"]


def test_markdown_report_parts_concatenate_in_order(spark, tmp_dir):
    import glob
    from lorekit.operators.lint import lint_report
    iss = spark.createDataFrame(
        [("suggestion", "sparse_article", f"concepts/{i:03d}.md", "d", 0) for i in range(50)]
        + [("error", "broken_link", "concepts/z.md", "Wikilink [[x]] points to a non-existent article", 1)],
        "severity string, check string, file string, detail string, pos int")
    out = os.path.join(tmp_dir, "report")
    scan.write_issues(lint_report(iss, "2024-02-01T00:00:00").repartition(7), out, fmt="markdown")
    text = "".join(open(p).read() for p in sorted(glob.glob(os.path.join(out, "part-*"))))
    lines = text.splitlines()
    assert lines[:4] == ["# Lint Report — 2024-02-01T00:00:00", "", "**1 errors, 0 warnings, 50 suggestions.**", ""]
    assert lines[4:8] == ["## Errors", "", "- **broken_link** · `concepts/z.md` — Wikilink [[x]] points to a "
                          "non-existent article", ""]
    assert lines[8:10] == ["## Suggestions", ""]
    assert lines[10] == "- **sparse_article** · `concepts/000.md` — d"
    assert lines[-2].startswith("- **sparse_article** · `concepts/049.md`") and lines[-1] == ""


def test_write_daily_appends_by_name(spark, tmp_dir):
    from lorekit.operators.dailies import render_daily, write_daily
    f = spark.createDataFrame([("2024-01-01 10:05:00", "Alpha", "did x"), ("2024-01-01 12:00:00", "Beta", "did y"),
                               ("2024-01-02 09:00:00", "Alpha", "did z")], "ts string, canonical string, body string")
    f = f.withColumn("ts", F.to_timestamp("ts"))
    out = os.path.join(tmp_dir, "daily")
    write_daily(render_daily(f.where("body <> 'did z'")), out)
    write_daily(render_daily(f.where("body = 'did z'")), out)      # a later flush appends
    d = spark.read.parquet(out)
    assert sorted(r["name"] for r in d.select("name").distinct().collect()) == ["2024-01-01.md", "2024-01-02.md"]
    day1 = [r["text"] for r in d.where("name = '2024-01-01.md'").orderBy(F.col("ts").asc_nulls_first()).collect()]
    assert day1 == ["# Daily Log: 01.01.2024\n\n## Sessions\n", "\n### Session (10:05) — Alpha\n\ndid x\n",
                    "\n### Session (12:00) — Beta\n\ndid y\n"]
