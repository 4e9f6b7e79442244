"""Quality rules and a line labeller: a linear-chain conditional random field, decoded by Viterbi.

Lines with a word are labelled content or boilerplate from binned counts. The field is trained here by gradient
ascent on its log-likelihood, on a bounded sample of labelled documents (``SAMPLE`` documents, ``SAMPLE_LINES`` lines
each, as windows over the whole of a longer one): lines of good documents count as content, but for repeated ones; lines of bad documents as boilerplate.
A document stays if it passes the base rules and content lines hold at least ``CONTENT_SHARE`` of its words."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekit.llm.text_features import block_counts
from lorekit.llm.textblocks import text_blocks

SAMPLE, SAMPLE_LINES, WINDOW_LINES = 2000, 64, 16
CONTENT_SHARE = 0.5
MIN_WORDS, MAX_REPEATED_PERCENT = 10, 20
CONTENT = 1
BINS = {
    "words": [2, 4, 8, 16, 32, 64, 128],
    "word_length": [2.0, 3.0, 4.0, 5.0, 6.5, 8.0, 12.0],
    "symbols": [1e-9, 0.01, 0.03, 0.06, 0.1, 0.2, 0.4],
    "digits": [1e-9, 0.02, 0.05, 0.1, 0.3],
    "upper": [1e-9, 0.02, 0.05, 0.1, 0.3],
    "stops": [1e-9, 0.02, 0.05, 0.1, 0.2, 0.5],
    "repeated": [1e-9, 0.1, 0.3, 0.6, 0.9],
    "ending": [0.5],
    "dup": [0.5],
}
SLOTS = 8                        # bins a feature at most


def line_bins(lines: dict) -> np.ndarray:
    """One bin number per line with a word and feature, counted through all features."""
    w = np.maximum(lines["words"], 1)
    c = np.maximum(lines["chars"], 1)
    values = {"words": lines["words"], "word_length": lines["chars"] / w, "symbols": lines["symbols"] / c, "digits": lines["digits"] / c,
              "upper": lines["upper"] / c, "stops": lines["stops"] / w, "repeated": lines["repeated"] / w,
              "ending": np.isin(lines["last"], list(b".!?")), "dup": lines["dup"]}
    return np.stack([np.searchsorted(b, values[k], side="right") + i * SLOTS for i, (k, b) in enumerate(BINS.items())], axis=1)


def fit_field(docs: list[tuple[np.ndarray, np.ndarray]], steps: int = 120, rate: float = 0.1, penalty: float = 1e-3) -> dict:
    """Weights {emit, move, start} of a two-label field from (bins, labels) of each document."""
    docs = [d for d in docs if len(d[1])]
    p = {"emit": np.zeros((len(BINS) * SLOTS, 2)), "move": np.zeros((2, 2)), "start": np.zeros(2)}
    if not docs:
        return p
    n, t = len(docs), max(len(y) for _, y in docs)
    x, y, on = np.zeros((n, t, len(BINS)), np.int64), np.zeros((n, t), np.int64), np.zeros((n, t), bool)
    for i, (b, lab) in enumerate(docs):
        x[i, :len(lab)], y[i, :len(lab)], on[i, :len(lab)] = b, lab, True
    hot = np.eye(2)[y] * on[..., None]
    moved = np.einsum("nta,ntb->ab", hot[:, :-1], hot[:, 1:])
    m1, m2 = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        e = p["emit"][x].sum(axis=2)
        a, b = np.zeros((n, t, 2)), np.zeros((n, t, 2))
        a[:, 0] = e[:, 0] + p["start"]
        for j in range(1, t):
            nxt = np.logaddexp.reduce(a[:, j - 1, :, None] + p["move"], axis=1) + e[:, j]
            a[:, j] = np.where(on[:, j, None], nxt, a[:, j - 1])
        for j in range(t - 2, -1, -1):
            prv = np.logaddexp.reduce(p["move"] + (e[:, j + 1] + b[:, j + 1])[:, None, :], axis=2)
            b[:, j] = np.where(on[:, j + 1, None], prv, 0)
        z = np.logaddexp.reduce(a[:, -1], axis=1)
        mass = np.exp(a + b - z[:, None, None]) * on[..., None]
        pair = np.exp(a[:, :-1, :, None] + p["move"] + (e[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None]) * on[:, 1:, None, None]
        diff = hot - mass
        g = {"emit": np.stack([np.bincount(x.ravel(), np.repeat(diff[..., k].ravel(), len(BINS)), len(BINS) * SLOTS) for k in range(2)], 1),
             "move": moved - pair.sum(axis=(0, 1)), "start": diff[:, 0].sum(axis=0)}
        for k in p:
            grad = g[k] / n - penalty * p[k]
            m1[k] = 0.9 * m1[k] + 0.1 * grad
            m2[k] = 0.99 * m2[k] + 0.01 * grad * grad
            p[k] = p[k] + rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)
    return p


def viterbi(row: np.ndarray, bins: np.ndarray, field: dict) -> np.ndarray:
    """Best label of each line; lines of a row stand together, and all rows advance one line a round."""
    e = field["emit"][bins].sum(axis=1)
    label = np.zeros(len(row), np.int64)
    if not len(row):
        return label
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    size = np.diff(np.append(first, len(row)))
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    score = e[first] + field["start"]
    back = np.zeros((len(row), 2), np.int64)
    for j in range(1, int(size[0])):
        k = int(np.searchsorted(-size, -j, side="left"))          # rows with more than j lines
        options = score[:k, :, None] + field["move"]
        back[first[:k] + j] = options.argmax(axis=1)
        score[:k] = options.max(axis=1) + e[first[:k] + j]
    label[first + size - 1] = score.argmax(axis=1)
    for j in range(int(size[0]) - 1, 0, -1):
        k = int(np.searchsorted(-size, -j, side="left"))
        at = first[:k] + j
        label[at - 1] = back[at, label[at]]
    return label


def sample_rows(docs: DataFrame, labels: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """(text, quality) of at most ``n`` labelled documents of the learning folds, by a hash of the id."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).withColumnRenamed("doc_id", "known_id")
    return docs.join(F.broadcast(known), docs[key] == F.col("known_id")).select(docs[text].alias("text"), "quality")


def sample_windows(n: int, seed: int) -> list[np.ndarray]:
    """The lines of a document of n lines to learn from: all of them as one chain, or ``SAMPLE_LINES`` as windows, one
    in each of as many equal parts of the whole document, at a place given by ``seed``."""
    if n <= SAMPLE_LINES:
        return [np.arange(n)]
    parts = SAMPLE_LINES // WINDOW_LINES
    edge = np.arange(parts + 1) * n // parts
    place = np.random.default_rng(seed).integers(0, edge[1:] - edge[:-1] - WINDOW_LINES + 1)
    return [np.arange(x, x + WINDOW_LINES) for x in edge[:-1] + place]


def sample_lines(batches):
    for batch in batches:
        for lo, offsets, raw in text_blocks(batch.column("text")):
            k = len(offsets) - 1
            _, lines = block_counts(offsets, raw)
            bins, use = line_bins(lines), lines["words"] > 0
            for i in range(k):
                own = np.flatnonzero(use & (lines["row"] == i))
                good = bool(batch.column("quality")[lo + i].as_py())
                at = [own[w] for w in sample_windows(len(own), zlib.crc32(raw[offsets[i]:offsets[i + 1]]))]
                yield pa.RecordBatch.from_arrays([pa.array([bins[w].astype(np.int16).tobytes() for w in at], pa.binary()),
                                                  pa.array([(good & ~lines["dup"][w]).astype(np.int8).tobytes() for w in at], pa.binary())], ["bins", "y"])


def train_field(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> dict:
    """Weights from at most ``SAMPLE`` documents; only their line bins reach the driver."""
    rows = sample_rows(docs, labels, key, text, SAMPLE).mapInArrow(sample_lines, "bins binary, y binary").collect()
    rows.sort()
    return fit_field([(np.frombuffer(r.bins, np.int16).reshape(-1, len(BINS)), np.frombuffer(r.y, np.int8)) for r in rows])


def verdicts(field: dict, content_share: float):
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share"]

    def f(batches):
        for batch in batches:
            for lo, offsets, raw in text_blocks(batch.column("text")):
                k = len(offsets) - 1
                rows, lines = block_counts(offsets, raw)
                use = lines["words"] > 0
                row, words = lines["row"][use], lines["words"][use]
                content = viterbi(row, line_bins(lines)[use], field) == CONTENT
                share = np.bincount(row, words * content, minlength=k) / np.maximum(rows["words"], 1)
                failed = (rows["words"] < MIN_WORDS) | (100 * rows["repeated"] > MAX_REPEATED_PERCENT * rows["words"])
                cols = [rows[c].astype(np.int64) for c in ("words", "chars", "symbols", "dup_lines", "repeated")]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, k), *map(pa.array, cols), pa.array(failed),
                                                  pa.array(~failed & (share >= content_share)), pa.array(share)], names)
    return f


def quality_rules(docs: DataFrame, field: dict, key: str = "doc_id", text: str = "text", content_share: float = CONTENT_SHARE) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_share) per row.

    A null or empty text has no words and fails the base rules. Rows are judged one by one, whatever their ids.
    Other columns are not read."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        verdicts(field, content_share), "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
        "n_repeat_words long, base_failed boolean, kept boolean, content_share double")
