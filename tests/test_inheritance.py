"""Inheritance along chains and random link graphs against the rules run one article at a time; the rewritten field."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lorekit.operators import inheritance
from lorekit.operators.attribution import backfill_projects_ordered, with_projects_field
from test_backfill_order import _brute

ARTICLES = "slug string, kind string, projects array<string>, body string, content string"
NARROWED = "slug string, narrowed array<string>"
NAMES = ["Alpha", "alpha", "Beta", "Gamma", "shared", "Delta"]


def rewritten(content, projects):
    end = content.find("\n---", 3)
    lines = [x for x in content[:end].split("\n") if not re.match(r"^projects:\s*", x)]
    return "\n".join([*lines, "projects: [" + ", ".join(projects) + "]"]) + content[end:]


def article(projects, body):
    field = "" if projects is None else f"projects: [{', '.join(projects)}]\n"
    return f"---\ntitle: x\n{field}sources: []\n---\n{body}"


def run(spark, arts, narrowed):
    rows = [(s, a["kind"], a["projects"], a["body"], article(a["projects"], a["body"])) for s, a in arts.items()]
    got = backfill_projects_ordered(spark.createDataFrame(rows, ARTICLES), spark.createDataFrame(list(narrowed.items()), NARROWED)).collect()
    want = _brute(arts, narrowed)
    assert {r.slug: list(r.projects) for r in got} == want
    assert {r.slug: r.content for r in got} == {s: rewritten(article(arts[s]["projects"], arts[s]["body"]), p) for s, p in want.items()}
    return want


def random_vault(seed, n, links):
    rnd = random.Random(seed)
    some = lambda most: [rnd.choice(NAMES) for _ in range(rnd.randint(0, most))]
    arts, slugs = {}, [f"{rnd.choice(['concepts', 'connections', 'qa'])}/a{i:03d}" for i in range(n)]
    for s in slugs:
        body = " ".join(f"[[{rnd.choice(slugs)}]]" if rnd.random() < 0.9 else "[[daily/2024-01-01.md]] [[gone]]" for _ in range(rnd.randint(0, links)))
        arts[s] = {"kind": s.split("/")[0], "projects": None if rnd.random() < 0.4 else some(3), "body": body}
    return arts, {s: some(2) for s in slugs if rnd.random() < 0.7}


@pytest.mark.parametrize("seed,n,links", [(1, 60, 1), (2, 60, 2), (3, 40, 6)])
def test_random_vaults(spark, seed, n, links):
    assert run(spark, *random_vault(seed, n, links))


def chain(n, projects):
    """Each article links to the one before."""
    return {f"concepts/c{i:04d}": {"kind": "concepts", "projects": projects(i), "body": f"[[concepts/c{i - 1:04d}]]" if i else ""} for i in range(n)}


@pytest.mark.parametrize("projects", [lambda i: None, lambda i: [["Alpha"], ["Beta", "Alpha"], None, ["shared"], []][i * i % 5],
                                      lambda i: ["Alpha", "Beta"] if i % 7 else None])
def test_a_chain_takes_logarithmic_rounds(spark, monkeypatch, projects):
    rounds = []
    real = inheritance.given_lists
    monkeypatch.setattr("lorekit.operators.attribution.given_lists", lambda *a: (lambda d, r: (rounds.append(r), (d, r))[1])(*real(*a)))
    arts = chain(1000, projects)
    want = run(spark, arts, {"concepts/c0000": ["Gamma"], "concepts/c0400": ["Delta"], "concepts/c0003": ["Beta"]})
    assert len(want) > 100 and rounds[0] <= 12


def test_field_of_an_article(spark):
    texts = ["---\nprojects: [a]\ntitle: t\n---\nbody", "---\ntitle: t\nprojects:\n  - a\n---\n\nx\n---\n", "no frontmatter", "---\nnever closed", "---\n---\n", "", "---"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(
        with_projects_field(F.col("t"), F.array(F.lit("B"), F.lit("c")))).collect()]
    assert got == ["---\ntitle: t\nprojects: [B, c]\n---\nbody", "---\ntitle: t\n  - a\nprojects: [B, c]\n---\n\nx\n---\n", "no frontmatter", "---\nnever closed",
                   "---\nprojects: [B, c]\n---\n", "", "---"]
