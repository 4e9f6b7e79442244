"""Quality rules and classifier: counts against plain Python, the field against enumeration, accuracy held out."""

import itertools
import zlib
from collections import Counter

import numpy as np
import pytest

from lorekit.llm import quality_classifier as C
from lorekit.llm import quality_rules as Q
from tests_llm import make, words

SF = "/root/testdata/sf0.01"


def counts(text):
    text = text or ""
    w, seen, dup = words(text), set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    cover = {i + k for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(cover)


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def field(tables):
    return Q.train_field(*tables)


def check_rules(rows, got):
    want = Counter()
    for d, t, _ in rows:
        n = counts(t)
        want[(d, *n, n[0] < 10 or 100 * n[4] > 20 * n[0])] += 1
    assert Counter(tuple(r)[:7] for r in got) == want
    assert not any(r.base_failed and r.kept for r in got)


def test_rules_of_messy_rows(spark, messy_rows, field):
    docs = make(spark, messy_rows)
    check_rules(messy_rows, Q.quality_rules(docs, field).collect())


def test_rules_of_documents(tables, field):
    docs, labels = tables
    got = Q.quality_rules(docs, field).collect()
    check_rules([(r.doc_id, r.text, None) for r in docs.collect()], got)
    label = {r.doc_id: r.quality for r in labels.collect()}
    rest = [(label[r.doc_id], r.kept) for r in got if r.doc_id in label and not r.base_failed and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert np.mean([q == k for q, k in rest]) > 0.95


def test_viterbi_and_training_against_enumeration():
    rng = np.random.default_rng(0)
    field = {"emit": rng.standard_normal((len(Q.BINS) * Q.SLOTS, 2)), "move": rng.standard_normal((2, 2)), "start": rng.standard_normal(2)}
    row = np.repeat([0, 2, 3, 7], [5, 1, 4, 8])
    bins = rng.integers(0, len(Q.BINS) * Q.SLOTS, (len(row), len(Q.BINS)))
    got, e = Q.viterbi(row, bins, field), field["emit"][bins].sum(axis=1)
    for r in np.unique(row):
        at = np.flatnonzero(row == r)
        value = lambda y: field["start"][y[0]] + sum(e[i, k] for i, k in zip(at, y)) + sum(field["move"][a, b] for a, b in zip(y, y[1:]))  # noqa: B023, E731
        assert tuple(got[at]) == max(itertools.product((0, 1), repeat=len(at)), key=value)
    assert len(Q.viterbi(row[:0], bins[:0], field)) == 0
    docs = [(bins[row == r], np.array([i % 2 for i in range((row == r).sum())])) for r in np.unique(row)]
    learned = Q.fit_field(docs, steps=300)
    assert all((Q.viterbi(np.zeros(len(y), int), b, learned) == y).all() for b, y in docs)


def test_scores_of_messy_rows(spark, messy_rows, tables):
    model = C.train(*tables)
    docs = make(spark, messy_rows)
    got = C.quality_scores(docs, model).collect()
    assert Counter((r.doc_id, r.held_out) for r in got) == Counter((d, d is not None and zlib.crc32(str(d).encode()) % 3 == 1) for d, *_ in messy_rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    kept = C.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got)


def test_held_out_accuracy(tables):
    docs, labels = tables
    got = {r.doc_id: r for r in C.quality_scores(docs, C.train(docs, labels)).collect()}
    held = [(r.quality, got[r.doc_id].predicted) for r in labels.collect() if got[r.doc_id].held_out]
    assert len(held) > 100 and np.mean([a == b for a, b in held]) > 0.95


def test_tables_are_lookups_and_pairs_help():
    rng = np.random.default_rng(1)
    x = rng.uniform(size=(4000, len(C.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)          # only a pair can tell
    model = C.fit(x, y)
    assert np.mean((C.score(model, x) >= 0.5) == y) > 0.9
    assert {(i, j) for i, j, _ in model["pairs"]} >= {(0, 1)}


def test_empty_tables(spark, tables):
    none, labels = make(spark, []), tables[1].limit(0)
    field, model = Q.train_field(none, labels), C.train(none, labels)
    assert Q.quality_rules(none, field).count() == 0 and C.quality_scores(none, model).count() == 0
    assert C.quality_scores(make(spark, [(1, "a", "s")]), model).first().score == 0.5


def test_training_windows_lie_all_over_a_document():
    assert [w.tolist() for w in Q.sample_windows(40, 1)] == [list(range(40))] and [w.tolist() for w in Q.sample_windows(0, 1)] == [[]]
    seen = set()
    for seed in range(300):
        at = Q.sample_windows(1000, seed)
        assert len(at) == 4 and all(len(w) == 16 and 250 * i <= w[0] and w[-1] < 250 * (i + 1) for i, w in enumerate(at))
        seen |= {int(x) for w in at for x in w}
    assert len(seen) > 950 and {0, 999} & seen
    assert all(w[-1] < 65 for w in Q.sample_windows(65, 3))


def test_scores_are_sums_of_table_entries(tables):
    """The additive model's score by looking up each feature and pair one after the other."""
    docs, labels = tables
    model = C.train(docs, labels)
    got = {r.doc_id: r.score for r in C.quality_scores(docs, model).collect()}
    assert model["pairs"] and len(got) == 1000
    for r in docs.limit(150).collect():
        raw = np.frombuffer((r.text or "").encode(), np.uint8)
        x = C.features(C.block_counts(np.array([0, len(raw)]), raw, windows=False)[0])[0]
        b = [sum(float(v) >= e for e in edges) for v, edges in zip(x, model["edges"])]
        s = model["base"] + sum(t[i] for t, i in zip(model["tables"], b)) + sum(v[b[i] * 16 // 64][b[j] * 16 // 64] for i, j, v in model["pairs"])
        assert abs(got[r.doc_id] - 1 / (1 + np.exp(-s))) < 1e-9
