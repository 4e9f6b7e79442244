"""The n-gram join and the embedding links against brute force."""

import math
import random

import numpy as np
import pytest

from lorekit.llm import ngram_join
from lorekit.operators.components import components
from lorekit.llm.embedding_dedup import embedding_links
from tests_llm import make, prose, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text):
    w = [x.translate(LOWER) for x in words(text)]
    return {tuple(w[i:i + 3]) for i in range(max(len(w) - 2, 1))} if w else set()


def expected_components(rows, percent=90):
    sets = [(d, shingles(t)) for d, t, _ in rows]
    links = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if a is not None and b is not None and x and y
             and 100 * len(x & y) >= percent * len(x | y)]
    root = roots({d for d, _ in sets if d is not None}, links)
    return sorted(((d, len(s), root.get(d)) for d, s in sets), key=str)


def test_components_of_messy_rows(spark, messy_rows):
    docs = make(spark, messy_rows)
    assert sorted(map(tuple, ngram_join.near_components(docs).collect()), key=str) == expected_components(messy_rows)
    kept = ngram_join.keep_first(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert {10, 1, 2, 17} <= set(ids) and not {6, 11, 12, 13} & set(ids) and ids.count(None) == 2


@pytest.mark.parametrize("hot,block", [(64, 1024), (3, 8)])
def test_chains_and_borders(spark, monkeypatch, hot, block):
    """Chains of edits (ends not similar to each other), and pairs just above and below the border."""
    monkeypatch.setattr(ngram_join, "HOT", hot)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rnd, rows = random.Random(5), []
    for g in range(6):
        w = prose(900 + g, 120 + 20 * g).split()
        for i in range(12):
            rows.append((100 * g + rnd.randrange(100), " ".join(w), "s"))
            w = list(w)
            for _ in range(1 + g % 3):
                w[rnd.randrange(len(w))] = f"e{g}x{i}"
    common = prose(950, 60)
    rows += [(1000 + i, common + " " + prose(951 + i, 4 + i % 5), "s") for i in range(30)]
    rows = list({r[0]: r for r in rows}.values())
    assert sorted(map(tuple, ngram_join.near_components(make(spark, rows)).collect()), key=str) == expected_components(rows)


def test_empty_tables(spark):
    assert ngram_join.near_components(make(spark, [])).count() == 0
    assert embedding_links(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_components_of_a_long_path(spark):
    order = list(range(200))
    random.Random(3).shuffle(order)
    got = components(spark.createDataFrame([*zip(order[:-1], order[1:]), (500, 501), (7, 7)], "a long, b long")).collect()
    assert {(r.node, r.component) for r in got} == {(i, 0) for i in range(200)} | {(500, 500), (501, 500)}


def test_adaptive_prefixes_keep_enough():
    """Similar sets share at least the smaller l within their prefixes, whatever l each takes."""
    rnd = random.Random(1)
    for _ in range(200):
        base = [rnd.getrandbits(64) for _ in range(rnd.randint(3, 80))]
        other = [rnd.getrandbits(64) if rnd.random() < 0.05 else x for x in base]
        counts = np.zeros(1 << ngram_join.SKETCH_BITS, np.uint32)
        for x in base:
            counts[x >> (64 - ngram_join.SKETCH_BITS)] = rnd.choice([1, 2, 50, 5000])
        sets = [sorted(set(base)), sorted(set(other))]
        row = np.repeat([0, 1], [len(s) for s in sets])
        rows, n, matches, size, flat = ngram_join.prefixes(row, np.array(sets[0] + sets[1], np.uint64), counts)
        a, b = set(flat[:size[0]].tolist()), set(flat[size[0]:].tolist())
        x, y = set(base), set(other)
        if 100 * len(x & y) >= 90 * len(x | y):
            assert len(a & b) >= matches.min()


def cosine_links(rows, bound=0.93):
    good = [r for r in rows if r[0] is not None and r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    unit = [np.array(r[1], np.float32).astype(float) for r in good]
    unit = [u / math.sqrt(u @ u) for u in unit]
    links = [(i, j) for i in range(len(good)) for j in range(i) if good[i][2] == good[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= bound]
    n = np.bincount(np.array(links, int).ravel(), minlength=len(good)) if links else np.zeros(len(good), int)
    root = roots({r[0] for r in rows if r[0] is not None}, [(good[i][0], good[j][0]) for i, j in links])
    count = {id(r): int(k) for r, k in zip(good, n)}
    return sorted([(r[0], count.get(id(r), 0), root.get(r[0]), r[0] is None or root[r[0]] == r[0]) for r in rows], key=str)


def test_embedding_links(spark):
    rng = np.random.default_rng(7)
    rows = []
    for g in range(12):
        centre = rng.standard_normal(32)
        for i in range(1 + 3 * g):
            rows.append((len(rows), (centre + 0.12 * rng.standard_normal(32)).astype(np.float32).tolist(), g % 3))
    same = rng.standard_normal(32).astype(np.float32).tolist()
    rows += [(1000 + i, same, 1) for i in range(60)] + [(2000 + i, same, 2) for i in range(3)]
    rows += [(3000, None, 1), (3001, [], 1), (3002, [0.0] * 32, 1), (3003, [None] + same[1:], 1), (3004, [float("nan")] + same[1:], 1),
             (3005, [float("inf")] + same[1:], 1), (3006, same, None), (None, same, 1), (3007, same[:16], 1), (3008, same[:16], 1)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, c1 string, n int")
    got = sorted(map(tuple, embedding_links(df).collect()), key=str)
    want = cosine_links(rows)
    assert [x[0] for x in got] == [x[0] for x in want]
    found, there = sum(x[1] for x in got), sum(x[1] for x in want)
    assert there > 4000 and 0.98 * there <= found <= there        # none below the bound, recall as designed
    assert sum(a[2:] != b[2:] for a, b in zip(got, want)) <= 2


def test_blocks_of_a_hot_bucket(spark, monkeypatch):
    from lorekit.llm import embedding_dedup
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(9)
    centre = rng.standard_normal(16)
    rows = [(i, (centre + 0.02 * rng.standard_normal(16)).tolist(), 1) for i in range(90)]
    got = embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(89, 0)}


def test_a_hot_group_is_cut_by_size(spark, monkeypatch):
    """A third of the rows behind one token, of many sizes: few of the block pairs are needed, and none that matters is left out."""
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    rnd = random.Random(3)
    sizes = [int(10 ** rnd.uniform(1, 4)) for _ in range(600)]
    members = spark.createDataFrame([(i, i % 3 and i + 10, n, 100) for i, n in enumerate(sizes)], "doc_id long, group long, n long, bytes long")
    places = ngram_join.block_places(members, 90).collect()
    assert len([p for p in places if p.group == 0]) < 200 * 13 / 3                  # 13 blocks, each with each, without levels
    met = {}
    for p in places:
        met.setdefault((p.group, p.other), []).append((p.doc_id, p.block))
    pairs = {(a, b) for rows in met.values() for a, x in rows for b, y in rows if a < b and (x != y or len({z for _, z in rows}) == 1)}
    hot = range(0, 600, 3)
    assert all((a, b) in pairs for a in hot for b in hot if a < b and 10 * min(sizes[a], sizes[b]) >= 9 * max(sizes[a], sizes[b]))


@pytest.mark.parametrize("block,volume", [(8, 8 << 20), (1024, 20_000)])
def test_a_template_in_a_third_of_the_documents(spark, monkeypatch, block, volume):
    """Pages of one long template with few words of their own, cut by count and by bytes: the same as brute force."""
    monkeypatch.setattr(ngram_join, "HOT", 8)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", volume)
    template, rnd, rows = prose(77, 300), random.Random(8), []
    for i in range(150):
        own = prose(5000 + i, rnd.choice([4, 12, 30, 60, 400]))
        rows.append((i, f"{template} {own}" if i % 3 == 0 else own, "a"))
    rows += [(200 + i, rows[3 * i][1] + " more", "b") for i in range(20)]
    got = sorted(map(tuple, ngram_join.near_components(make(spark, rows)).collect()), key=str)
    assert got == expected_components(rows)
