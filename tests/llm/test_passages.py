"""Substring and suffix dedup against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from lorekit.llm import suffix_dedup as SD
from lorekit.llm.substring_dedup import SuffixAutomaton, substring_dedup, windows_seen
from tests_llm import make, prose


def expected(rows, window, unit):
    """Per row (sorted by id, then text): (id, size, removed, spans, sha256)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    tokens = [(t or "").encode().split() if unit == "word" else (t or "").encode() for _, t, _ in rows]
    windows = [[tuple(x[s:s + window]) if unit == "word" else x[s:s + window] for s in range(len(x) - window + 1)] for x in tokens]
    count, seen, out = Counter(w for ws in windows for w in ws), set(), []
    for (doc, *_), x, ws in zip(rows, tokens, windows):
        drop = np.zeros(len(x), bool)
        for s, w in enumerate(ws):
            if (w in seen) if unit == "word" else count[w] > 1:
                drop[s:s + window] = True
            seen.add(w)
        kept = [v for v, d in zip(x, drop) if not d]
        kept = b" ".join(kept) if unit == "word" else bytes(kept)
        spans = int(np.diff(np.concatenate([[0], drop.astype(int)])).clip(0).sum())
        out.append((doc, len(x), int(drop.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("unit,f,size,window", [("word", substring_dedup, "n_words", 20), ("byte", SD.suffix_dedup, "n_bytes", 400)])
def test_messy_rows(spark, messy_rows, unit, f, size, window):
    got = f(make(spark, messy_rows)).select("doc_id", size, "n_removed", "n_spans", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == expected(messy_rows, window, unit)


@pytest.mark.parametrize("f", [substring_dedup, SD.suffix_dedup])
def test_empty_table(spark, f):
    assert f(make(spark, [])).count() == 0


def test_matching_statistics():
    auto = SuffixAutomaton()
    for s in ("abcabd", "xaby", ""):
        auto.add(s)
    for text in ("abcaby", "zzabdx", "xabcab", ""):
        want = [max(k for k in range(i + 1) if any(text[i - k:i] in s for s in ("abcabd", "xaby"))) for i in range(1, len(text) + 1)]
        assert auto.matching_statistics(text) == want


def groups(n, unit_size):
    left, right = prose(1, 40), prose(2, 40)
    texts = [(prose(i % 5, 6) + left[-30:] + "ANCHOR" + right[:30 + i % 7] + prose(i % 3 + 50, 8)) for i in range(n)]
    return [[(t.index("ANCHOR"), np.frombuffer(t.encode(), np.uint8).astype(unit_size)) for t in texts]]


def test_split_shards_give_the_same_windows():
    whole = list(windows_seen(groups(40, np.uint64), 20))
    small = list(windows_seen(groups(40, np.uint64), 20, max_states=100))
    assert [[x.tolist() for x in g] for g in whole] == [[x.tolist() for x in g] for g in small] and any(len(x) for x in whole[0])


def test_column_rounds_against_brute_force_and_in_blocks():
    group = groups(40, np.uint8)[0]
    distinct = list({(a, t.tobytes()): (a, t) for a, t in group}.values())
    want = [[r for r in range(len(t) - 30 + 1) if r <= a and r + 30 >= a + 6
             and any(r - a + b >= 0 and t[r:r + 30].tobytes() == u[r - a + b:r - a + b + 30].tobytes() for j, (b, u) in enumerate(distinct) if j != i)]
            for i, (a, t) in enumerate(distinct)]
    for lot in (4096, 8):
        found = [g for g in SD.windows_elsewhere([distinct], 30, lot=lot)][0]
        anchored = [[r for r in x.tolist() if r <= a and r + 30 >= a + 6] for x, (a, _) in zip(found, distinct)]
        assert anchored == want
