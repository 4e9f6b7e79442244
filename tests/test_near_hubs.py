"""Bands of near duplicates: which rows are compared, and the comparison of blocks against all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest

from lorekit.operators import duplicates
from lorekit.operators.components import components


def _compared(monkeypatch):
    """The rows sent to each round of comparisons."""
    sent, real = [], duplicates.cut_lineage

    def cut(df):
        df = real(df)
        if "other" in df.columns:
            sent.append(df.count())
        return df
    monkeypatch.setattr(duplicates, "cut_lineage", cut)
    return sent


def test_hubs_leave_nothing_to_compare(spark, monkeypatch):
    """Rows that hardly link to each other but all to one row, which is neither the smallest nor taken by hash."""
    monkeypatch.setattr(duplicates, "PIVOTS", 4)
    sent, rnd = _compared(monkeypatch), random.Random(3)
    rows = [(10**6, list(range(64)))]
    for k in range(200):
        own = rnd.sample(range(4, 64), 24)
        rows.append((k, [rnd.randrange(10**3, 10**9) if at in own else at for at in range(64)]))
    links = duplicates.near_links(spark.createDataFrame(rows, "k long, sig array<long>"))
    assert {r.node: r.component for r in components(links).collect()} == {k: 0 for k, _ in rows}
    assert len(sent) == 2 and sent[1] == 0


def test_small_bands_are_compared_once(spark, monkeypatch):
    sent, rnd = _compared(monkeypatch), random.Random(6)
    rows = []
    for g in range(30):
        sig = [rnd.randrange(10**9) for _ in range(64)]
        rows += [(10 * g + i, sig[:at] + [rnd.randrange(10**9) for _ in range(64 - at)]) for i, at in enumerate((64, 44, 40, 20))]
    links = duplicates.near_links(spark.createDataFrame(rows, "k long, sig array<long>"))
    assert {r.node: r.component for r in components(links).collect()} == {k: k - k % 10 for k, _ in rows if k % 10 < 3}
    assert len(sent) == 1


@pytest.mark.parametrize("kinds", [3, 40, 2000])
def test_blocks_against_all_pairs(kinds):
    """Few values, and more in a column than a byte can number; a block with itself, two blocks, and groups of a few rows."""
    rnd = np.random.default_rng(kinds)
    base = rnd.integers(0, 10**9, (kinds, 64))
    rows = []
    for band, (x, y), n in ((5, (0, 0), 150), (6, (0, 2), 700), (7, (1, 1), 9), (8, (0, 1), 12), (9, (0, 3), 30), (5, (0, 1), 5000)):
        for i in range(n):
            sig = np.where(rnd.random(64) < 0.7, base[rnd.integers(kinds)], base[rnd.integers(kinds)])
            block = 3 if band == 9 else (x, y)[int(rnd.random() < (0.02 if n == 5000 else 0.5))]        # one side of band 9 is empty
            rows.append((band, x * 1000 + y, block, sig))
    rnd.shuffle(rows)
    band, other, block, sig = (np.array(c) for c in zip(*rows))
    key = np.arange(len(rows))
    table = pa.table({"k": key, "band": band, "other": other, "block": block, "sig": pa.array(list(sig))})
    out = duplicates._block_links(38.4, 1000)(table)

    def parts(pairs):
        up = list(key)

        def top(a):
            while up[a] != a:
                up[a] = a = up[up[a]]
            return a
        for a, b in pairs:
            a, b = sorted((top(a), top(b)))
            up[b] = a
        return [top(a) for a in key]
    pairs = []
    for a in key:
        x, y = divmod(other[a], 1000)
        b = np.flatnonzero((band == band[a]) & (other == other[a]) & (block == y) & (key != a)) if block[a] == x else key[:0]
        pairs += [(a, c) for c in b[(sig[b] == sig[a]).sum(axis=1) >= 38.4]]
    found = list(zip(*(out[c].to_pylist() for c in "ab")))
    assert pairs and parts(found) == parts(pairs) and len(found) == len(key) - len(set(parts(pairs)))
