"""Line dedup and the source mix against plain Python."""

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lorekit.llm import line_dedup, source_mix
from tests_llm import make, words


def boilerplate(rows, least=10):
    """{line: id of its home} of the lines on at least that many sites; no id comes last."""
    sites, home = defaultdict(set), {}
    for d, t, s in rows:
        for line in (t or "").split("\n"):
            if words(line):
                sites[line] |= {s} - {None}
                home[line] = min(home.get(line, d), d, key=lambda x: (x is None, x))
    return {x: home[x] for x, s in sites.items() if len(s) >= least}


def expected_lines(rows, least=10):
    bad, out = boilerplate(rows, least), []
    for d, t, _ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if bad.get(x, d) == d]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return Counter(out)


def test_lines_of_messy_rows(spark, messy_rows):
    docs = make(spark, messy_rows)
    got = Counter(map(tuple, line_dedup.line_report(docs).collect()))
    assert got == expected_lines(messy_rows)
    assert sum(n for (_, _, removed, _), n in got.items() if removed) == 27      # 28 pages with shared lines; the first is their home
    kept = line_dedup.line_dedup(docs)
    assert kept.columns == docs.columns and kept.count() == len(messy_rows)
    assert kept.where("text IS NULL").count() == docs.where("text IS NULL").count()


def test_boilerplate_goes_whatever_its_share(spark):
    """Pages that are mostly boilerplate, pages that are nothing else, and a line without an id or a site."""
    rows = [(i, f"one line that every site has\nown {i}", f"s{i}") for i in range(12)]
    rows += [(100 + i, "another line of twelve sites", f"s{i}") for i in range(12)] + [(None, "another line of twelve sites", None), (300, "", "s1"), (301, None, "s1")]
    rows += [(None, "nobody's line", f"s{i}") for i in range(11)]
    docs = make(spark, rows)
    got = Counter(map(tuple, line_dedup.line_report(docs).collect()))
    assert got == expected_lines(rows) and sum(r[2] for r in got.elements()) == 11 + 12
    left = line_dedup.line_dedup(docs, keep_emptied=False).collect()
    assert sorted(r.doc_id for r in left if r.doc_id is not None) == [*range(12), 100, 300, 301] and sum(r.doc_id is None for r in left) == 11


def test_threshold_neighbours_are_counted_exactly(spark):
    rows = [(100 * n + i, f"line on {n} sites\n" + "own text " * 10 + str(100 * n + i), f"s{i}") for n in (8, 9, 10, 11, 14, 40) for i in range(n)]
    got = Counter(map(tuple, line_dedup.line_report(make(spark, rows)).collect()))
    assert got == expected_lines(rows)


def test_spread_estimates_are_close(spark):
    rows = spark.range(40_000).select((F.col("id") % 40).alias("line"), F.xxhash64(F.floor(F.col("id") / 40)).alias("site")).distinct()
    for r in line_dedup.spread_estimates(rows).collect():
        assert abs(r.spread - 1000) < 350


def plan(sizes, weights=(5, 2, 1)):
    """Targets by repeated resharing."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w, target, left, open_ = {s: weights[i % 3] for i, s in enumerate(order)}, {}, sum(sizes.values()), set(order)
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            target |= share
            break
        target |= {s: 3 * sizes[s] for s in over}
        left, open_ = left - sum(3 * sizes[s] for s in over), open_ - over
    return target


def check_mix(rows, got):
    sizes, n = defaultdict(int), Counter()
    for d, t, s in rows:
        sizes[s] += len(words(t))
        n[d, len(words(t))] += 1
    target = plan(sizes)
    assert Counter((r.doc_id, r.size) for r in got) == n
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        s = next(s for s in sizes if sizes[s] == r.source_size and abs(target[s] - r.target) < 1e-6 * max(1, r.target))
        assert r.size == 0 and r.taken == 0 or r.taken in (0, r.size, 2 * r.size, 3 * r.size)
        taken[r.source_size, r.target] += r.taken
        largest[r.source_size, r.target] = max(largest[r.source_size, r.target], n[r.doc_id, r.size] * r.size)
        assert s in sizes
    for (size, goal), x in taken.items():
        alike = sum(sizes[s] == size and abs(target[s] - goal) < 1e-6 * max(1, goal) for s in sizes)
        assert abs(x - alike * goal) <= alike * largest[size, goal] / 2 + 1e-6


def test_mix_of_messy_rows(spark, messy_rows):
    docs = make(spark, messy_rows)
    got = source_mix.mix_report(docs).collect()
    check_mix(messy_rows, got)
    assert sorted(got, key=str) == sorted(source_mix.mix_report(docs.repartition(5)).collect(), key=str)
    mixed = source_mix.mix_sources(docs)
    assert mixed.columns == docs.columns
    sizes = sum(len(words(r.text)) for r in mixed.select("text").collect())
    assert sizes == sum(r.taken for r in got)


@pytest.mark.parametrize("rows", [[], [(1, None, "a"), (2, "", None)], [(1, "a b c", None)], [(i, "w " * (i % 9 + 1), "a" if i else "b") for i in range(50)]])
def test_mix_of_small_tables(spark, rows):
    check_mix(rows, source_mix.mix_report(make(spark, rows)).collect())


def test_lines_of_an_empty_table(spark):
    assert line_dedup.line_report(make(spark, [])).count() == 0
