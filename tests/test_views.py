"""Views and table functions in SQL give what the library's functions give."""

from conftest import SF_SMALL
from lorekit.operators import lint
from lorekit.plans.vault import Vault
from lorekit.plans.views import FUNCTIONS, VIEWS, register_views


def test_every_view_and_function_answers(spark):
    made = register_views(spark, SF_SMALL)
    assert made == [f"kb_{n}" for n in (*VIEWS, *FUNCTIONS)]
    for name in VIEWS:
        assert spark.sql(f"SELECT count(*) FROM kb_{name}").first()[0] >= 0
    v = Vault(spark, SF_SMALL)
    slug = v["links"].where("NOT is_daily").groupBy("target").count().orderBy("count", "target", ascending=False).first().target
    got = spark.sql("SELECT * FROM kb_links_to(:a)", {"a": slug})
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, v["links"].where("NOT is_daily").where(v["links"].target == slug).select("src", "pos", "raw").collect()))
    issue = lint.lint_all(v).orderBy("file").first()
    got = [tuple(r) for r in spark.sql("SELECT severity, check, detail FROM kb_issues_of(:f)", {"f": issue.file}).collect()]
    assert (issue.severity, issue.check, issue.detail) in got
    project = v["sections"].where("project IS NOT NULL").first().project
    assert spark.sql("SELECT count(*) FROM kb_sections_of(upper(:p))", {"p": project}).first()[0] == v["sections"].where(v["sections"].project == project).count()


def test_only_the_views_that_are_asked_for(spark):
    assert register_views(spark, SF_SMALL, ["links"]) == ["kb_links", "kb_links_to"]
    assert register_views(spark, SF_SMALL, ["turns"]) == ["kb_turns"]
