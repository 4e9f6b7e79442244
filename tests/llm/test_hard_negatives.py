"""Hard negatives against a plain comparison of all pairs."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekit.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, uid string, v int, lot int, cell string, wins int, known long"


def make_vectors(spark, rows):
    return spark.createDataFrame([(i, v, y, "u", 1, 2, "c", 3, 4) for i, v, y in rows], SCHEMA)


def expected(rows, positives=5, negatives=3):
    dim = max((len(v) for _, v, _ in rows if v), default=0)
    used = []
    for i, v, y in rows:
        if i is not None and y is not None and v and all(x is not None and math.isfinite(x) for x in v):
            used.append((i, y, [math.floor(256 * float(np.float32(x))) for x in v] + [0] * (dim - len(v))))
    out = Counter()
    for a, (i, y, q) in enumerate(used):
        if i % 50:
            continue
        scored = [(-sum(p * r for p, r in zip(q, v)), j, b, z == y) for b, (j, z, v) in enumerate(used)]
        kin = sorted(s[:3] for s in scored if s[3] and s[2] != a)[:positives]
        for s, j, _ in kin:
            fits = sorted(t for t in scored if not t[3] and -50 * s <= -100 * t[0] <= -95 * s)[:negatives]
            out.update((i, j, r, t[1], -s, -t[0]) for r, t in enumerate(fits, 1))
    return out


def mined(spark, rows):
    return Counter(map(tuple, H.hard_negatives(make_vectors(spark, rows), F.col("vec_id") % 50 == 0).collect()))


def cloud(seed, n, dim=8, labels=4, spread=0.4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, dim))
    return [(i, [float(np.float32(x)) for x in centres[i % labels] + spread * rng.normal(size=dim)], int(rng.integers(0, labels))) for i in range(n)]


def messy():
    rows = cloud(1, 400)
    rows += [(None, [1.0] * 8, 1), (450, None, 1), (451, [1.0] * 8, None), (500, [], 1), (550, [1.0, None] + [0.5] * 6, 2), (551, [float("nan")] * 8, 2),
             (600, [float("inf")] * 8, 3), (650, [0.0] * 8, 1), (700, [0.5] * 5, 2), (701, [3.0], 1), (750, [-0.3] * 8, 9), (751, [-0.3] * 8, 9)]
    rows += [(100, rows[100][1], rows[100][2]), (100, rows[100][1], rows[100][2])]                # repeated anchors
    rows += [(800 + i, rows[3][1], rows[3][2] if i % 2 else 7) for i in range(60)]               # ties
    return rows


def test_messy_vectors(spark, monkeypatch):
    rows = messy()
    want = expected(rows)
    assert mined(spark, rows) == want and len(want) > 80
    monkeypatch.setattr(H, "LOT_ROWS", 25)                              # the same from many lots
    assert mined(spark, rows) == want


def test_a_third_of_the_rows_alike(spark, monkeypatch):
    monkeypatch.setattr(H, "LOT_ROWS", 40)
    rows = cloud(2, 450, dim=6, labels=3)
    rows = [(i, rows[0][1] if i % 3 == 0 else v, y) for i, v, y in rows]
    assert mined(spark, rows) == expected(rows)


@pytest.mark.parametrize("rows", [[], [(None, None, None)], [(50, [1.0, 2.0], 1)], [(50, [1.0], 1), (51, [1.0], 1), (52, [0.75], 2)],
                                  [(0, [1.0, -2.0], 1), (1, [-1.0, 2.0], 1), (2, [0.5, 0.5], 2)]])
def test_few_vectors(spark, rows):
    assert mined(spark, rows) == expected(rows)


def test_products_are_exact_whatever_their_size():
    x = np.array([[2.0**40, 3.0], [2.0**62, 2.0**62], [-2.0**62, -1.0]])
    assert H.products(x, np.array([2.0**20, 1.0])).tolist() == [2**60 + 3, H.HIGH, H.LOW]
    assert H.products(x[:1], np.array([5.0, 7.0])).tolist() == [5 * 2**40 + 21]


def test_a_visit_stops_before_the_last_cell(spark):
    """With clusters far apart, only the cells near the anchor are scored."""
    rng = np.random.default_rng(5)
    centres = 20 * rng.normal(size=(16, 8))
    rows = [(i, [float(x) for x in centres[i % 16] + 0.01 * rng.normal(size=8)], i % 2) for i in range(800)]
    scored, calls = H.scored_rows(make_vectors(spark, rows), "vec_id", "embedding", "label", 256), []
    index, book = H.multi_index(scored)
    lot = H.Lot(index.toArrow().to_batches(), book)
    plain, H.products = H.products, lambda x, q: calls.append(len(x)) or plain(x, q)
    try:
        best = lot.visit(lot.x[0], "0", -1, [{"no": 0, "lo": H.LOW, "hi": H.HIGH, "known": H.LOW}], 5, True)[0]
    finally:
        H.products = plain
    same = lot.codes["0"] == lot.code
    assert best == sorted(zip((-(lot.x[same] @ lot.x[0])).astype(int).tolist(), lot.vec_id[same].tolist(), lot.uid[same].tolist()))[:5]
    assert sum(calls) < 400
