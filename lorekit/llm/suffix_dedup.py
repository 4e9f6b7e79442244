"""Suffix-array dedup: column-wise construction for many documents at once.

The passages that share an anchor gram (see ``passages``) are laid under each other, aligned at the gram. Rounds
go from the last column to the first; each inserts one symbol per passage before its suffix, which updates the
suffix order (a stable sort of the last order by the new symbol: the Burrows-Wheeler step) and the common
prefixes of neighbours (one more than the range minimum of the last ones, or none). Equal byte strings that hold
the gram stand in the same column, so each column's own order is enough, and a round costs its passages, not all
suffixes so far. A common prefix of ``window`` bytes or more marks a repeated string.

The rounds read their columns and write the next order in sequence; they are arrays of a bounded lot of passages
within a task, fed from Spark's shuffle files, since executors must not count on files of their own."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lorekit.llm.passages import covered, repeated_windows

WINDOW, GRAM = 400, 200
LOT = 4096                       # passages a lot, so at most about 3 MB of symbols


def column_rounds(groups: list, window: int) -> list:
    """Windows of each passage that another passage of its group has. groups: lists of (anchor, bytes)."""
    passages = [(g, a, t) for g, group in enumerate(groups) for a, t in group]
    m = len(passages)
    left, right = max(a for _, a, _ in passages), max(len(t) - a for _, a, t in passages)
    symbols = np.zeros((left + right, m), np.int16)
    for j, (_, a, t) in enumerate(passages):
        symbols[left - a:left - a + len(t), j] = t.astype(np.int16) + 1
    group = np.array([g for g, _, _ in passages], np.int64)
    order = np.arange(m)                                   # by group, then by suffix
    common = np.zeros(m + 1, np.int32)                     # with the passage before; 0 at the end
    hits = np.zeros((left + right, m), bool)
    for c in range(left + right - 1, -1, -1):
        symbol = symbols[c][order]
        key = group[order] * 512 + symbol
        step = np.argsort(key, kind="stable")
        before, same = step[:-1], np.flatnonzero((key[step][1:] == key[step][:-1]) & (symbol[step][1:] > 0))
        new = np.zeros(m + 1, np.int32)
        if len(same):
            ends = np.empty(2 * len(same), np.int64)
            ends[0::2], ends[1::2] = before[same] + 1, step[1:][same] + 1
            new[same + 1] = np.minimum.reduceat(common, ends)[0::2] + 1
        order, common = order[step], new
        found = np.maximum(common[:-1], common[1:]) >= window
        if found.any():
            hits[c, order[found]] = True
    return [np.flatnonzero(hits[left - a:left - a + len(t), j]) for j, (_, a, t) in enumerate(passages)]


def windows_elsewhere(groups, window: int, lot: int = LOT):
    """For each segment of each group the windows that another segment of the group has.

    Small groups share a lot; a group of more than ``lot`` passages is worked on in pairs of blocks."""
    pending: list = []

    def flush():
        flat = iter(column_rounds(pending, window)) if pending else iter(())
        return [[next(flat) for _ in g] for g in pending]

    for group in groups:
        if sum(map(len, pending)) + len(group) > lot and pending:
            yield from flush()
            pending = []
        if len(group) <= lot:
            pending.append(group)
            continue
        half = lot // 2
        blocks = [range(i, min(i + half, len(group))) for i in range(0, len(group), half)]
        found: list = [np.zeros(0, np.int64)] * len(group)
        for i, a in enumerate(blocks):
            for b in blocks[i + 1:]:
                rows = [*a, *b]
                for j, x in zip(rows, column_rounds([[group[j] for j in rows]], window)):
                    found[j] = np.union1d(found[j], x)
        yield found
    yield from flush()


def kept_bytes(window: int, with_text: bool):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept_bytes"] * with_text

    def f(ids, texts: pa.Array, cut, first, last) -> pa.Table:
        rows = []
        for i, (doc_id, text) in enumerate(zip(ids, texts)):
            raw = text.as_buffer().to_pybytes()
            n, gone, spans = len(raw), 0, 0
            if cut[i] < cut[i + 1]:
                drop = covered(n, first[cut[i]:cut[i + 1]], last[cut[i]:cut[i + 1]], window)
                gone, spans = int(drop.sum()), int(drop[0]) + int((drop[1:] & ~drop[:-1]).sum())
                raw = np.frombuffer(raw, np.uint8)[~drop].tobytes()
            rows.append((doc_id, n, gone, spans, hashlib.sha256(raw).hexdigest(), *[raw] * with_text))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), [*[pa.int64()] * 4, pa.string(), pa.binary()])], names=names)
    return f


def suffix_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM,
                 with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept_bytes]) per document without the UTF-8 bytes that
    lie in a string of ``window`` bytes that also starts anywhere else in the corpus.

    A null or empty text has no bytes and the hash of the empty string. Rows may share an id or have none; each is
    a document. What is kept need not be valid UTF-8. Other columns are not read."""
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_bytes binary" * with_text
    return repeated_windows(docs, key, text, "byte", window, gram, False, windows_elsewhere, kept_bytes(window, with_text), schema)
