"""Quality classifier: a generalised additive model with pairwise interactions.

Features are counts of the text alone, cut into quantile bins. Boosting goes round the features: each turn fits a
shallow tree (``LEAVES`` leaves) of one feature to the gradient and adds it to that feature's lookup table; then the
same for the ``PAIRS`` pairs that explain most of what is left, on a grid of coarse bins. A score is the sum of one
table entry per feature and pair. Learning takes at most ``SAMPLE`` labelled documents (a documented bound), of the
rows whose crc32(id) mod 3 is not 1."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekit.llm.quality_rules import sample_rows
from lorekit.llm.text_features import block_counts
from lorekit.llm.textblocks import text_blocks

SAMPLE = 20_000
BINS, COARSE, LEAVES = 64, 16, 4
ROUNDS, PAIR_ROUNDS, RATE, PAIRS = 120, 40, 0.15, 6
SMOOTH = 1.0
KEEP_BYTES = 1 << 20             # of text at once where rows are passed on whole; a worker keeps what it once took
FEATURES = ("words", "word_length", "symbols", "digits", "upper", "stops", "marks", "wide", "dup_lines", "line_words",
            "stutter", "distinct", "spaces")


def features(rows: dict) -> np.ndarray:
    """One row of numbers per text; an empty text is all zeros."""
    w, c, b = (np.maximum(rows[k], 1) for k in ("words", "chars", "bytes"))
    n = np.maximum(rows["lines"], 1)
    return np.stack([np.log1p(rows["words"]), rows["chars"] / w, rows["symbols"] / c, rows["digits"] / c, rows["upper"] / c,
                     rows["stops"] / w, rows["marks"] / w, rows["wide"] / c, rows["dup_lines"] / n, np.log1p(rows["words"] / n),
                     rows["stutter"] / w, rows["distinct"] / np.sqrt(w), (rows["bytes"] - rows["chars"]) / b], axis=1)


def best_steps(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values of a tree of at most LEAVES leaves over ordered bins with gradient and weight sums g and h."""
    cuts, score = [0, len(g)], lambda a, b: g[a:b].sum()**2 / (h[a:b].sum() + SMOOTH)
    cg, ch = np.append(0, np.cumsum(g)), np.append(0, np.cumsum(h))
    while len(cuts) <= LEAVES:
        best = (1e-9, None)
        for a, b in zip(cuts[:-1], cuts[1:]):
            k = np.arange(a + 1, b)
            if not len(k):
                continue
            left, right = (cg[k] - cg[a])**2 / (ch[k] - ch[a] + SMOOTH), (cg[b] - cg[k])**2 / (ch[b] - ch[k] + SMOOTH)
            gain = left + right - score(a, b)
            if gain.max() > best[0]:
                best = (gain.max(), int(k[gain.argmax()]))
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(cuts[:-1], cuts[1:]):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + SMOOTH)
    return out


def quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, values) of the best tree with one cut along each side of a grid."""
    cg, ch = (np.pad(m.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for m in (g, h))
    i, j = np.meshgrid(np.arange(1, len(g)), np.arange(1, g.shape[1]), indexing="ij")
    parts = lambda c: (c[i, j], c[i, -1] - c[i, j], c[-1, j] - c[i, j], c[-1, -1] - c[i, -1] - c[-1, j] + c[i, j])
    gain = sum(a * a / (b + SMOOTH) for a, b in zip(parts(cg), parts(ch)))
    at = np.unravel_index(gain.argmax(), gain.shape)
    p, q = at[0] + 1, at[1] + 1
    out = np.zeros_like(g)
    for a in (slice(0, p), slice(p, None)):
        for b in (slice(0, q), slice(q, None)):
            out[a, b] = g[a, b].sum() / (h[a, b].sum() + SMOOTH)
    return float(gain.max() - cg[-1, -1]**2 / (ch[-1, -1] + SMOOTH)), out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> dict:
    """{base, edges, tables, pairs} from feature rows and 0/1 labels; no rows give a score of one half."""
    d = len(FEATURES)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(d)]
    model = {"base": 0.0, "edges": edges, "tables": [np.zeros(BINS) for _ in range(d)], "pairs": []}
    if not len(x) or y.min() == y.max():
        model["base"] = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))) if len(y) else 0.0
        return model
    b = np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)], 1)
    model["base"] = float(np.log(y.mean() / (1 - y.mean())))
    s = np.full(len(y), model["base"])
    sums = lambda at, size: [np.bincount(at, v, size) for v in (y - sigmoid(s), sigmoid(s) * (1 - sigmoid(s)))]
    for _ in range(ROUNDS):
        for f in range(d):
            step = RATE * best_steps(*sums(b[:, f], BINS))
            model["tables"][f] += step
            s += step[b[:, f]]
    c = b * COARSE // BINS
    grid = lambda i, j: [m.reshape(COARSE, COARSE) for m in sums(c[:, i] * COARSE + c[:, j], COARSE * COARSE)]
    ranked = sorted(((quadrants(*grid(i, j))[0], i, j) for i in range(d) for j in range(i + 1, d)), reverse=True)[:PAIRS]
    model["pairs"] = [(i, j, np.zeros((COARSE, COARSE))) for _, i, j in ranked]
    for _ in range(PAIR_ROUNDS):
        for i, j, values in model["pairs"]:
            step = RATE * quadrants(*grid(i, j))[1]
            values += step
            s += step[c[:, i], c[:, j]]
    return model


def score(model: dict, x: np.ndarray) -> np.ndarray:
    b = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(model["edges"])]
    s = np.full(len(x), model["base"])
    for f, values in enumerate(model["tables"]):
        s += values[b[f]]
    for i, j, values in model["pairs"]:
        s += values[b[i] * COARSE // BINS, b[j] * COARSE // BINS]
    return sigmoid(s)


def _feature_rows(batches):
    for batch in batches:
        for lo, offsets, raw in text_blocks(batch.column("text")):
            x = features(block_counts(offsets, raw, windows=False)[0])
            yield pa.RecordBatch.from_arrays([batch.column("quality").slice(lo, len(x)), pa.array([r.tobytes() for r in x], pa.binary())],
                                             ["quality", "x"])


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> dict:
    """The model from at most ``SAMPLE`` labelled documents; only their features reach the driver."""
    rows = sample_rows(docs, labels, key, text, SAMPLE).mapInArrow(_feature_rows, "quality int, x binary").collect()
    rows.sort()
    x = np.array([np.frombuffer(r.x) for r in rows]).reshape(-1, len(FEATURES))
    return fit(x, np.array([r.quality for r in rows], float))


def quality_scores(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) per row; rows without id are not held out. A null text scores as an
    empty one. Rows are scored one by one, whatever their ids; other columns are not read."""
    def f(batches):
        for batch in batches:
            for lo, offsets, raw in text_blocks(batch.column("text")):
                p = score(model, features(block_counts(offsets, raw, windows=False)[0]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, len(p)), batch.column("held_out").slice(lo, len(p)),
                                                  pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                                                 ["doc_id", "held_out", "score", "predicted"])
    held = F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))
    return docs.select(F.col(key).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text).alias("text")).mapInArrow(
        f, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model accepts, with the columns of ``docs``."""
    def f(batches):
        for batch in batches:
            good = [score(model, features(block_counts(o, raw, windows=False)[0])) >= 0.5 for _, o, raw in text_blocks(batch.column(text), KEEP_BYTES)]
            if good:
                yield batch.filter(pa.array(np.concatenate(good)))
    return docs.mapInArrow(f, docs.schema)
