"""Counts of rows and of their lines over a block of texts; all of it numpy."""

from __future__ import annotations

import numpy as np

from lorekit.llm.textblocks import by_row_and_hash, prefix_hash, range_hash, word_hashes, word_spans, BYTE_VALUES

WINDOW = 5
CLASSES = {"symbols": b"#*$%&|<>", "digits": b"0123456789", "upper": bytes(range(65, 91)), "stops": b".!?",
           "marks": b",;:'\"()-"}
MASKS = {}
for _name, _bytes in CLASSES.items():
    MASKS[_name] = np.zeros(256, bool)
    MASKS[_name][list(_bytes)] = True
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def running(mask: np.ndarray) -> np.ndarray:
    out = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=out[1:])
    return out


def lines_of(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the lines of non-empty rows, without an empty one at a row's end."""
    nl = np.flatnonzero(raw == 0x0A)
    start = np.unique(np.concatenate([offsets[:-1], nl + 1]))
    start = start[start < len(raw)]
    row = np.searchsorted(offsets, start, side="right") - 1
    after = np.searchsorted(nl, start)
    end = np.minimum(np.append(nl, len(raw))[after], offsets[row + 1])
    return start, end, row


def block_counts(offsets: np.ndarray, raw: np.ndarray, windows: bool = True) -> tuple[dict, dict]:
    """(row counts, line counts): words, chars (code points in words), the CLASSES, dup (line equals an earlier
    one of its row; lines with a word only), repeated words (in a WINDOW found twice or more in the row)."""
    rows = len(offsets) - 1
    ws, we, before = word_spans(offsets, raw)
    ls, le, lrow = lines_of(offsets, raw)
    wrow = np.repeat(np.arange(rows), np.diff(before))
    masks = {k: running(m[raw]) for k, m in MASKS.items()}
    masks["chars"] = running(((raw & 0xC0) != 0x80) & ~SPACE[raw])
    masks["wide"] = running(raw >= 0xC0)
    prefix = prefix_hash(BYTE_VALUES[raw])
    line_words = np.searchsorted(ws, le) - np.searchsorted(ws, ls)
    lines = {k: m[le] - m[ls] for k, m in masks.items()} | {"row": lrow, "words": line_words, "chars_all": le - ls}
    out = {k: m[offsets[1:]] - m[offsets[:-1]] for k, m in masks.items()} | {"words": np.diff(before), "bytes": np.diff(offsets)}

    lh = range_hash(prefix, ls, le)
    order = np.lexsort((ls, lh, lrow))
    same = np.zeros(len(ls), bool)
    same[order[1:]] = (lh[order][1:] == lh[order][:-1]) & (lrow[order][1:] == lrow[order][:-1])
    lines["dup"] = same & (line_words > 0)
    lines["last"] = raw[np.maximum(le - 1, 0)] if len(raw) else np.zeros(0, np.uint8)
    out["dup_lines"] = np.bincount(lrow[lines["dup"]], minlength=rows)
    out["lines"] = np.bincount(lrow[line_words > 0], minlength=rows)

    h = word_hashes(raw, ws, we)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (wrow[1:] == wrow[:-1])
    out["stutter"] = np.bincount(wrow[again], minlength=rows)
    order = by_row_and_hash(wrow, h, rows)
    r, x = wrow[order], h[order]
    out["distinct"] = np.bincount(r[np.append(True, (r[1:] != r[:-1]) | (x[1:] != x[:-1]))], minlength=rows) if len(h) else np.zeros(rows, np.int64)
    if windows:
        step = np.zeros(len(h) + 1, np.int32)
        first = np.arange(max(len(h) - WINDOW + 1, 0))
        first = first[first + WINDOW <= before[1:][wrow[:len(first)]]]
        if len(first):
            g = range_hash(prefix_hash(h), first, first + WINDOW)
            order = by_row_and_hash(wrow[first], g, rows)
            r, x = wrow[first][order], g[order]
            twin = (r[1:] == r[:-1]) & (x[1:] == x[:-1])
            hit = first[order[np.append(twin, False) | np.append(False, twin)]]
            np.add.at(step, hit, 1)
            np.add.at(step, hit + WINDOW, -1)
        covered = running(np.cumsum(step[:-1]) > 0)
        out["repeated"] = covered[before[1:]] - covered[before[:-1]]
        lines["repeated"] = covered[np.searchsorted(ws, le)] - covered[np.searchsorted(ws, ls)]
    return out, lines
