"""Attribution where lists repeat: no side of a join is broadcast, and the rows are those of the plain rules."""

import re

from pyspark.sql import functions as F

from lorekit.operators import attribution
from lorekit.operators.inheritance import ordered_distinct_ci

ARTICLES = "slug string, kind string, body string, content string, projects array<string>"


def _stored(spark, df, path):
    df.write.parquet(path)
    return spark.read.parquet(path)


def test_donors_are_not_broadcast(spark, tmp_dir):
    rows = [(f"qa/q{i}", f"[[concepts/c{i}]] [[concepts/c{i + 1}|two]] [[daily/2024-01-01]]") for i in range(50)]
    arts = spark.createDataFrame(rows, "slug string, body string")
    donors = _stored(spark, spark.range(60).select(F.concat(F.lit("concepts/c"), F.col("id")).alias("slug"),
                                                   F.array(F.lit("B"), F.lit("shared"), F.lit("a")).alias("projects")), f"{tmp_dir}/donors")
    out = attribution.inherit_projects(arts, None, donors)
    assert {tuple(r.inherited) for r in out.collect()} == {("B", "a")} and out.count() == 50
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_spellings_of_a_list(spark):
    rows = [(["b", "A", "B", "a", "c"],), ([],), (None,)]
    got = spark.createDataFrame(rows, "x array<string>").select(ordered_distinct_ci(F.col("x")).alias("y")).collect()
    assert [r.y for r in got] == [["b", "A", "c"], [], None]


def _mentions(body, alias):
    return re.search(rf"(?<!\w){re.escape(alias)}(?!\w)" if re.fullmatch(r"\w+", alias) else rf"\b{re.escape(alias)}\b", body.lower()) is not None


def test_mentions_are_found_from_the_words_of_a_body(spark, tmp_dir):
    registry = [(1, "Alpha", ["al-pha", "x"], "alpha"), (2, "Beta", ["beta two", "(b)"], None), (3, "Gamma", ["--"], "g.m"), (4, "Delta", ["größe"], "Alpha-2")]
    bodies = ["see Alpha", "al-pha", "al pha", "Beta two", "beta  two", "a(b)c", "(b)", "a--b", "-- g.m", "gxm", "die GRÖSSE und Größe", "alpha-2 x", "", "alphabet betatwo"]
    rows = [(f"a{i}", b, ["Alpha", "Beta", "Delta", "Gamma"]) for i, b in enumerate(bodies)] + [("one", "alpha", ["Beta"]), ("a0", "beta two", ["Alpha", "Beta", "Delta", "Gamma"])]
    reg = spark.createDataFrame(registry, "ord int, canonical string, aliases array<string>, name string")
    arts = _stored(spark, spark.createDataFrame([r[:2] for r in rows], "slug string, body string"), f"{tmp_dir}/a")
    derived = _stored(spark, spark.createDataFrame([(s, d) for s, _, d in rows[:-1]], "slug string, derived array<string>"), f"{tmp_dir}/d")
    out = attribution.narrow_by_mention(arts, derived, reg)
    names = {c: [x.lower() for x in [c, *a, *([n] if n else [])]] for _, c, a, n in registry}
    names["Alpha"] = [x for x in names["Alpha"] if x != "alpha-2"]
    want = []
    for s, b, d in rows:
        hit = [c for c in d if any(_mentions(b, x) for x in names[c])]
        want.append((s, tuple(sorted(hit) if len(d) > 1 and hit else d)))
    assert sorted((r.slug, tuple(r.narrowed)) for r in out.collect()) == sorted(want)
    assert "regexp_extract_all" not in out._jdf.queryExecution().executedPlan().toString()      # the bodies' words are taken once, not an alias at a time


def test_the_vault_writes_a_body_once(spark, tmp_dir):
    from lorekit.operators.extract import build_articles
    from lorekit.plans import vault
    docs = spark.createDataFrame([(i, f"  \u00e4 text {i}\n---\n", f"src{i}") for i in range(1, 9)] + [(9, None, "src9")], "doc_id long, text string, source string")
    for name in ("documents", "events", "conversations"):
        docs.write.parquet(f"{tmp_dir}/{name}.parquet")
    v = vault.Vault(spark, tmp_dir)
    want = build_articles(v["files"])
    assert v["articles"].columns == want.columns and sorted(map(tuple, v["articles"].collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert "body" not in v["article_files"].columns


def _plans(monkeypatch):
    """The plans of all tables that are written on the way."""
    from lorekit.operators import inheritance
    from lorekit.session import cut_lineage
    seen = []

    def noted(df):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return cut_lineage(df)
    monkeypatch.setattr(attribution, "cut_lineage", noted)
    monkeypatch.setattr(inheritance, "cut_lineage", noted)
    return seen


def _vault(spark, tmp_dir):
    head = "---\ntitle: x\n---\n"
    rows = [(f"concepts/c{i:02d}", "concepts", f"[[concepts/c{i // 2:02d}]] [[concepts/c{i // 3:02d}]]") for i in range(40)]
    rows += [(f"qa/q{i}", "qa", f"[[concepts/c{i:02d}]] [[qa/q{i // 2}]]") for i in range(10)]
    arts = spark.createDataFrame([(s, k, b, head + b, None if i % 3 else ["Own"]) for i, (s, k, b) in enumerate(rows)], ARTICLES)
    narrowed = spark.createDataFrame([(s, ["b", "A", "B"] if i % 2 else []) for i, (s, _, _) in enumerate(rows)], "slug string, narrowed array<string>")
    return _stored(spark, arts, f"{tmp_dir}/arts"), _stored(spark, narrowed, f"{tmp_dir}/narrowed")


def test_rounds_broadcast_nothing(spark, tmp_dir, monkeypatch):
    seen = _plans(monkeypatch)
    out = attribution.backfill_projects_ordered(*_vault(spark, tmp_dir))
    seen.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(seen) > 5 and not [p for p in seen if "Broadcast" in p]
    got = {r.slug: list(r.projects) for r in out.collect()}
    assert got["concepts/c01"] == ["b", "A"] and got["qa/q9"] == ["Own", "b", "A"]


def test_unions_of_one_hop_are_worked_out_once(spark, tmp_dir, monkeypatch):
    arts, narrowed = _vault(spark, tmp_dir)
    out = attribution.backfill_projects(arts, None, narrowed, None)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "array_distinct" not in plan and "Broadcast" not in plan
    got = {r.slug: list(r.projects) for r in out.collect()}
    assert got["concepts/c01"] == ["b", "A"] and got["qa/q1"] == ["b", "A"]


def test_words_are_counted_as_python_does(spark):
    texts = ["a\x1cb", "a b c", "　a b​", "plain words here", "grüße é", "", None]
    from lorekit.functions.text import word_count
    got = [r.n for r in spark.createDataFrame([(t,) for t in texts], "t string").select(word_count("t").alias("n")).collect()]
    assert got == [None if t is None else len(t.split()) for t in texts]
