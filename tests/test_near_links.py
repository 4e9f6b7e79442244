"""Links of a band whose smallest row is unrelated, against all pairs of the band."""

import random

import pytest

from lorekit.operators import duplicates
from lorekit.operators.components import components


def _sig(rnd, band):
    return band + [rnd.randrange(10**6) for _ in range(60)]


@pytest.mark.parametrize("as_key,block", [(int, 2048), (str, 8), (int, 8)])
def test_links_past_the_first_row(spark, monkeypatch, as_key, block):
    monkeypatch.setattr(duplicates, "BLOCK", block, raising=False)
    rnd, shared = random.Random(4), [1, 2, 3, 4]
    rows = [(1, _sig(rnd, shared))]                       # smallest of the band, like no other row
    for g in range(12):
        sig = _sig(rnd, shared)
        for i in range(4):
            rows.append((100 + 10 * g + i, list(sig)))
            for at in range(4, 64 if i != 2 else 4, 4):   # no other band is shared
                sig[at + rnd.randrange(4)] = rnd.randrange(10**6)
    up = {k: k for k, _ in rows}
    for a, x in rows:
        for b, y in rows:
            if a < b and sum(p == q for p, q in zip(x, y)) >= 0.6 * 64:
                lo, hi = sorted((up[a], up[b]))
                up = {k: lo if v == hi else v for k, v in up.items()}
    df = spark.createDataFrame([(as_key(k), s) for k, s in rows], f"k {'long' if as_key is int else 'string'}, sig array<long>")
    got = {r.node: r.component for r in components(duplicates.near_links(df)).collect()}
    sizes = {v: list(up.values()).count(v) for v in up.values()}
    assert got == {as_key(k): as_key(v) for k, v in up.items() if sizes[v] > 1} and len(got) == 48


def test_large_bands_meet_some_rows_first(spark, monkeypatch):
    """A band of several components: its rows meet few of its rows, then only those outside the largest component meet all."""
    monkeypatch.setattr(duplicates, "PIVOTS", 4)
    monkeypatch.setattr(duplicates, "BLOCK", 16)
    compared = []
    real = duplicates._block_links
    monkeypatch.setattr(duplicates, "_block_links", lambda *a: (compared.append(a), real(*a))[1])
    rnd, shared = random.Random(5), [9, 8, 7, 6]
    rows, at = [(0, _sig(rnd, shared))], 1
    for g in range(3):
        sig = _sig(rnd, shared)
        for i in range(30):
            mine = list(sig)
            for j in range(4, 64, 4):
                mine[j + rnd.randrange(4)] = rnd.randrange(10**6)
            rows.append((at, mine))
            at += 1
    df = spark.createDataFrame(rows, "k long, sig array<long>")
    got = {r.node: r.component for r in components(duplicates.near_links(df)).collect()}
    assert got == {k: 1 + 30 * ((k - 1) // 30) for k in range(1, 91)}
    assert len(compared) == 2
