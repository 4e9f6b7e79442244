"""Substring dedup: suffix automata of reference shards give matching statistics.

A reference shard holds the passages of one anchor gram (see ``passages``): the first copy of every distinct
segment that shares the gram. Segments are streamed through the shard's automaton in the order of the corpus:
its state gives the longest match that ends at each word, and a match of at least ``window`` words marks a window
that also starts earlier. Then the segment joins the automaton. Segments that repeat as a whole need no
automaton. Shards are routed by gram rather than broadcast, because the repeated text grows with the corpus."""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lorekit.llm.passages import covered, repeated_windows

WINDOW, GRAM = 20, 8
MAX_STATES = 400_000


class SuffixAutomaton:
    """Suffix automaton of a set of sequences, extended one symbol at a time."""

    def __init__(self):
        self.moves: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def _split(self, p: int, c, q: int) -> int:
        """The state for the longest match of p followed by c, cut off from q where q is longer."""
        if self.length[q] == self.length[p] + 1:
            return q
        twin = len(self.moves)
        self.moves.append(dict(self.moves[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = twin
        while p >= 0 and self.moves[p].get(c) == q:
            self.moves[p][c] = twin
            p = self.link[p]
        return twin

    def add(self, sequence) -> None:
        last = 0
        for c in sequence:
            q = self.moves[last].get(c)
            if q is not None:
                last = self._split(last, c, q)
                continue
            new = len(self.moves)
            self.moves.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            p = last
            while p >= 0 and c not in self.moves[p]:
                self.moves[p][c] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, c, self.moves[p][c])
            last = new

    def matching_statistics(self, sequence) -> list[int]:
        """For each position the length of the longest match that ends there."""
        moves, link, length = self.moves, self.link, self.length
        state = n = 0
        out = []
        for c in sequence:
            nxt = moves[state].get(c)
            while nxt is None and state:
                state = link[state]
                n = length[state]
                nxt = moves[state].get(c)
            if nxt is not None:
                state, n = nxt, n + 1
            out.append(n)
        return out


def windows_seen(groups, window: int, max_states: int = MAX_STATES):
    """For each segment of each group the windows that an earlier segment of the group has.

    An automaton of more than ``max_states`` states is closed and the next one begun; later segments stream
    through all of them, so memory is bounded by an automaton and the segments."""
    for group in groups:
        sequences = [t.tolist() for _, t in group]
        hits = [np.zeros(len(s), bool) for s in sequences]
        i = 0
        while i < len(sequences):
            shard = SuffixAutomaton()
            while i < len(sequences) and len(shard.moves) < max_states:
                if i:
                    hits[i] |= np.array(shard.matching_statistics(sequences[i])) >= window
                if i + 1 < len(sequences):
                    shard.add(sequences[i])
                i += 1
            for j in range(i, len(sequences)):
                hits[j] |= np.array(shard.matching_statistics(sequences[j])) >= window
        yield [np.flatnonzero(h) - window + 1 for h in hits]


def kept_rows(window: int, with_text: bool):
    names = ["doc_id", "n_words", "n_removed", "n_spans", "kept_sha256"] + ["kept_text"] * with_text

    def f(ids, texts: pa.Array, cut, first, last) -> pa.Table:
        rows = []
        for i, (doc_id, text) in enumerate(zip(ids, texts)):
            words = text.as_buffer().to_pybytes().split()
            n, gone, spans = len(words), 0, 0
            if cut[i] < cut[i + 1]:
                drop = covered(n, first[cut[i]:cut[i + 1]], last[cut[i]:cut[i + 1]], window)
                gone, spans = int(drop.sum()), int(drop[0]) + int((drop[1:] & ~drop[:-1]).sum())
                words = compress(words, ~drop)
            kept = b" ".join(words)
            rows.append((doc_id, n, gone, spans, hashlib.sha256(kept).hexdigest(), *[kept.decode()] * with_text))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), [*[pa.int64()] * 4, *[pa.string()] * 2])], names=names)
    return f


def substring_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM,
                    with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, n_spans, kept_sha256[, kept_text]) per document without the words that lie in
    a window of ``window`` words that also starts earlier (smaller id, or earlier in the same document).

    A null or empty text has no words and the hash of the empty string. Rows with one id are ordered by text,
    rows without id come first. Other columns are not read."""
    schema = "doc_id long, n_words long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text
    return repeated_windows(docs, key, text, "word", window, gram, True, windows_seen, kept_rows(window, with_text), schema)
