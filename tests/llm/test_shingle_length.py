"""The n-gram join with another shingle length against brute force: five words, similarity 0.8 or more."""

import random

import pytest

from lorekit.llm import ngram_join
from test_joins import LOWER, roots
from tests_llm import make, prose, words


def shingles(text, k=5):
    w = [x.translate(LOWER) for x in words(text)]
    return {tuple(w[i:i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()


def firsts(rows):
    sets = [(d, shingles(t)) for d, t, _ in rows]
    links = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if a is not None and b is not None and x and y
             and 100 * len(x & y) >= 80 * len(x | y)]
    root = roots({d for d, _ in sets if d is not None}, links)
    return {d for d in root if root[d] == d}


def edited(text, n, seed):
    w, rnd = text.split(), random.Random(seed)
    for i in rnd.sample(range(0, len(w), 6), n):
        w[i] = f"e{seed}x{i}"
    return " ".join(w)


@pytest.mark.parametrize("hot,block", [(64, 1024), (3, 8)])
def test_near_copies_at_the_border(spark, monkeypatch, messy_rows, hot, block):
    """Copies with one to eight edits: 0.8 of five words lies between."""
    monkeypatch.setattr(ngram_join, "HOT", hot)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = [r for r in messy_rows if r[0] is not None]
    for g in range(8):
        base = prose(700 + g, 200)
        rows += [(10000 + 100 * g, base, "a"), (10001 + 100 * g, edited(base, g + 1, g), "b")]
    kept = {r.doc_id for r in ngram_join.keep_first(make(spark, rows), percent=80, shingle=5).select("doc_id").collect()}
    assert kept == firsts(rows)
    assert {10001 + 100 * g for g in range(8)} & kept == {10001 + 100 * g for g in range(4, 8)}
