"""Ordinary vault contents that the table fixtures do not hold: CRLF files, several new projects, rows a proposal does
not touch, list quoting, many short index rows, spaced links, repeated appends, secrets across lines, missing files."""

import datetime as dt
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from lorekit.operators import attribution, dailies, digest, instincts, scope
from lorekit.sources import adapters, scan


def _write(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def test_unchanged_crlf_log_is_not_pending(spark, tmp_dir):
    raw = b"# Daily Log: 01.01.2024\r\n\r\n## Sessions\r\n"
    _write(f"{tmp_dir}/daily/2024-01-01.md", raw)
    logs = scan.scan_vault(spark, tmp_dir, layers=("daily",))
    state = spark.createDataFrame([("2024-01-01.md", hashlib.sha256(raw).hexdigest()[:16])], "name string, hash string")
    assert dailies.pending_dailies(logs, state).count() == 0
    assert dailies.pending_dailies(logs, state.withColumn("hash", F.lit("0" * 16))).count() == 1


REGISTRY = "ord int, id string, name string, canonical string, aliases array<string>, root string, remote string"


def test_new_projects_have_their_own_place(spark):
    registry = spark.createDataFrame([(0, "shared", "shared", "Shared", ["shared", "all"], None, None)], REGISTRY)
    detected = spark.createDataFrame([(1, "cc", "gamma", "/g", None), (2, "aa", "alpha", "/a", None), (3, "ab", "beta", "/b", None),
                                      (4, "aa", "later", "/x", None), (5, None, "n", None, None)],
                                     "session_id long, id string, name string, root string, remote string")
    out = scope.register_projects(registry, detected, "2024-02-01")
    assert sorted((r.ord, r.id, r.name) for r in out.collect()) == [(0, "shared", "shared"), (1, "aa", "alpha"), (2, "ab", "beta"), (3, "cc", "gamma")]
    found = scope.resolve_aliases(spark.createDataFrame([("alpha",)], "ident string"), out).collect()
    assert {r.alias_lc for r in found} == {"alpha"}
    empty = scope.register_projects(registry.limit(0), detected, "2024-02-01")
    assert sorted(r.ord for r in empty.collect()) == [0, 1, 2]


def test_upsert_leaves_other_rows_alone(spark):
    schema = ("key string, trigger string, action string, domain string, confidence decimal(6,2), source string, evidence_count long, "
              "created date, last_seen date, updated date, projects array<string>")
    day = dt.date(2024, 1, 1)
    old = spark.sql("SELECT 1").selectExpr(
        "inline(array(named_struct('key', 'kept', 'projects', array('alpha')), named_struct('key', 'hit', 'projects', array('beta'))))")
    old = old.select("key", F.lit("t").alias("trigger"), F.lit("a").alias("action"), F.lit("d").alias("domain"),
                     F.lit("0.50").cast("decimal(6,2)").alias("confidence"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("evidence_count"),
                     *[F.lit(day).alias(c) for c in ("created", "last_seen", "updated")], "projects")
    assert old.columns == [c.split()[0] for c in schema.split(", ")]
    new = spark.createDataFrame([("hit", "t2", "a2", None, None, None, dt.datetime(2024, 1, 2))],
                                "id string, trigger string, action string, domain string, confidence double, evidence string, ts timestamp")
    out, _ = instincts.upsert_instincts(old, new)
    assert {r.key: (r.projects, r.trigger) for r in out.collect()} == {"kept": (["alpha"], "t"), "hit": (["shared"], "t2")}
    text = {r.key: r.text for r in instincts.render_instincts(out.withColumn(
        "projects", F.when(F.col("key") == "kept", F.array(F.lit("Alpha"), F.lit("b, c"))).otherwise(F.col("projects")))).collect()}
    assert 'projects: [Alpha, "b, c"]' in text["kept"] and "projects: [shared]" in text["hit"]


def test_equal_times_give_one_answer(spark):
    ts = dt.datetime(2024, 1, 2)
    rows = [("k", f"t{i}", f"a{i}", None, 0.3 + i / 10, None, ts) for i in range(4)]
    schema = "id string, trigger string, action string, domain string, confidence double, evidence string, ts timestamp"
    got = {str(instincts.upsert_instincts(None, spark.createDataFrame(rows[i:] + rows[:i], schema).repartition(3))[0].first()) for i in range(4)}
    assert len(got) == 1


def test_digest_shows_every_short_row_that_fits(spark):
    n = 3000
    scoped = spark.range(n).select(F.col("id").alias("pos"), F.lit("|[[a]]").alias("raw"), F.lit("current").alias("scope"))
    project = spark.createDataFrame([("P", "id1")], "canonical string, id string")
    none = spark.createDataFrame([], "key string, trigger string, action string, domain string, confidence decimal(6,2), last_seen date")
    wiki = spark.createDataFrame([], "line string")
    pointer = spark.createDataFrame([], "label_text string, name string, n_sessions long, last_header string")
    for budget, cut in ((20000, True), (100000, False)):
        rows = digest.session_digest(scoped, project, none, wiki, pointer, "2024-01-31 10:00:00", budget).orderBy("part", "pos").collect()
        text = "".join(r.text for r in rows if r.part < 9)
        assert (len(text) == budget) == cut and any(r.part == 9 for r in rows) == cut
        assert text.count("[[a]]") >= (n if not cut else (budget - 600) // 7)


def test_spaced_links_inherit(spark):
    arts = spark.createDataFrame([("qa/q", "see [[ concepts/a ]] and [[ daily/2024-01-01 ]]")], "slug string, body string")
    donors = spark.createDataFrame([("concepts/a", ["Alpha"])], "slug string, projects array<string>")
    assert [tuple(r) for r in attribution.inherit_projects(arts, None, donors).collect()] == [("qa/q", ["Alpha"])]


def test_title_once_a_day(spark, tmp_dir):
    path = os.path.join(tmp_dir, "daily")
    for hour in (9, 10):
        f = spark.createDataFrame([(dt.datetime(2024, 1, 5, hour), "Src1", "x")], "ts timestamp, canonical string, body string")
        dailies.write_daily(dailies.render_daily(f), path)
    rows = spark.read.parquet(path)
    assert rows.where(F.col("text").startswith("# Daily Log")).count() == 1 and rows.count() == 3
    known = spark.createDataFrame([("2024-01-05.md",)], "name string")
    assert dailies.render_daily(f, existing=known).count() == 1


def test_secret_across_lines(spark):
    text = "one\r\ntwo\npassword:\n  abcdefgh12345678\nthree token=abcdefgh12345678"
    d = spark.createDataFrame([(4, text, "src1"), (5, "clean", "src1")], "doc_id long, text string, source string")
    got = adapters.findings_from_documents(d).collect()
    assert sorted((r.line, r.title, r.severity, r.hit_pos) for r in got) == [(3, "Secret: password", "critical", 0), (5, "Secret: token", "critical", 1)]


def test_missing_layers_and_files_give_no_rows(spark, tmp_dir):
    assert scan.scan_vault(spark, f"{tmp_dir}/nothing").count() == 0
    assert scan.scan_registry(spark, f"{tmp_dir}/projects.json").count() == 0
    assert scan.scan_compile_state(spark, f"{tmp_dir}/state.json").count() == 0
    _write(f"{tmp_dir}/v/knowledge/index.md", b"# Knowledge Base Index\n")
    _write(f"{tmp_dir}/v/knowledge/concepts/a.md", b"x")
    assert {(r.slug, r.kind) for r in scan.scan_vault(spark, f"{tmp_dir}/v").collect()} == {("index", "root"), ("concepts/a", "concepts")}


def test_slugs_without_a_number(spark):
    from lorekit.sources.adapters import index_from_articles as build_index
    a = spark.createDataFrame([("concepts/plain", "text", ["A"])], "slug string, body string, projects array<string>")
    assert build_index(a).count() == 1


def test_a_cluster_needs_the_shared_folder(spark):
    from lorekit import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

        def getConf(self):  # noqa: N802
            return {}

    class Session:
        sparkContext = Context()  # noqa: N815
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


def test_new_data_under_an_old_path(spark, tmp_dir):
    from lorekit.plans.vault import Vault
    for n in (2, 3):
        spark.range(n).selectExpr("id AS doc_id", "'text' AS text", "concat('src', id) AS source", "'en' AS lang").write.mode("overwrite").parquet(f"{tmp_dir}/documents.parquet")
        for t in ("events", "conversations"):
            spark.range(1).write.mode("overwrite").parquet(f"{tmp_dir}/{t}.parquet")
        assert Vault(spark, tmp_dir)["articles"].count() == n


def test_instinct_files(spark):
    files = [("a.md", '---\nid: "k: 1"\ntrigger: \'t\'\n  action: a: b\n# note: x\nprojects: [Alpha, "b", ]\nconfidence: 0.4\n'
              'confidence: 0.75\ncreated: 2024-01-02\nlast_seen: soon\n---\n# Title\nid: other\n'),
             ("stem.md", "---\ntrigger: t\nprojects: solo\n---\n"), ("c.md", "no header"), ("d.md", "---\nplain\n---\n")]
    got = {r.key: r for r in instincts.parse_instinct_files(spark.createDataFrame(files, "name string, content string")).collect()}
    assert set(got) == {"k: 1", "stem"}
    k = got["k: 1"]
    assert (k.trigger, k.action, k.projects, str(k.confidence), str(k.created), k.last_seen) == ("t", "a: b", ["Alpha", "b"], "0.75", "2024-01-02", None)
    assert got["stem"].projects == ["solo"] and got["stem"].confidence is None
