"""Hard-negative mining over an inverted multi-index.

Two codebooks, one for each half of a vector's components, are fitted on a bounded sample; every row lies in the cell
of its two nearest centroids. A half's score with an anchor is at most its centroid's plus the half's norm times the
centroid's radius, and a cell's score at most the sum of both. Cells are kept in lots of bounded size. In a lot, an
anchor visits the cells in falling order of that sum, which a heap takes from the two sorted lists of half bounds
(multi-sequence), and stops once the sum cannot enter any of its windows: its answer is then certified, not guessed.
A first round visits each anchor's most promising lot and gives thresholds; the second all lots that may still matter.

So results are exact whatever the codebooks; these only decide how much is looked at. Close vectors of high dimension
bound little, and then an anchor visits most lots."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorekit.session import cut_lineage

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
SAMPLE = 20_000                  # rows that the codebooks are fitted on
CENTROIDS = 64                   # of a half at most, so a directory has 4,096 cells at most
LOT_ROWS, SCORED = 4096, 512      # rows of a lot; rows of visited cells that are scored at once
TASKS = 10_000
SEED, LLOYD = 7, 8
LOW, HIGH = -(1 << 63) + 1, (1 << 63) - 1
ROW = "uid long, vec_id long, label string, v array<double>"
WINS = "wins array<struct<no: int, lo: long, hi: long, known: long>>"
VISIT_NAMES = ["lot", "kind", "uid", "vec_id", "label", "v", "cell", "r1", "r2", "wins"]
VISIT = f"lot int, kind int, {ROW}, cell int, r1 double, r2 double, {WINS}"


# ── index ─────────────────────────────────────────────────────────────

def padded(column, dim: int) -> np.ndarray:
    """The rows of a list column as a matrix; shorter ones are filled with zeros."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(flat.offsets.to_numpy())
    out = np.zeros((len(flat), dim))
    if len(flat):
        out[np.repeat(np.arange(len(flat)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = flat.flatten().to_numpy(zero_copy_only=False)
    return out


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centroid, distance) of each row."""
    with np.errstate(all="ignore"):
        far = (centroids * centroids).sum(axis=1) - 2 * x @ centroids.T
        at = np.nan_to_num(far, nan=np.inf).argmin(axis=1)
        gap = np.sqrt(((x - centroids[at]) ** 2).sum(axis=1))
    return at, np.nan_to_num(gap, nan=np.inf, posinf=np.inf)


def codebook(x: np.ndarray, k: int) -> np.ndarray:
    """At most k centroids of the rows, by Lloyd's rounds from rows taken at random."""
    rng = np.random.default_rng(SEED)
    c = np.unique(x[rng.permutation(len(x))[:k]], axis=0)
    for _ in range(LLOYD):
        at, _ = nearest(x, c)
        n = np.bincount(at, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def _placed(c1: np.ndarray, c2: np.ndarray, dim: int):
    half = dim // 2

    def f(batches):
        for b in batches:
            x = padded(b.column("v"), dim)
            (i, r1), (j, r2) = nearest(x[:, :half], c1), nearest(x[:, half:], c2)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("uid", "vec_id", "label", "v")], pa.array((i * len(c2) + j).astype(np.int32)), pa.array(r1), pa.array(r2)],
                                             ["uid", "vec_id", "label", "v", "cell", "r1", "r2"])
    return f


def multi_index(rows: DataFrame) -> tuple[DataFrame, dict] | None:
    """(rows with their cell and lot, directory) of ``rows`` (uid, vec_id, label, v); None without rows.

    The directory has a line per cell with rows: half centroids, radii and the lots that hold it. A cell larger than
    a lot is spread over several."""
    n, dim = rows.select(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not n:
        return None
    taken = rows.orderBy(F.xxhash64("vec_id", "uid")).limit(SAMPLE).select("v").toArrow()
    x = padded(taken["v"], dim)
    k = int(np.clip(2 * n ** 0.25, 4, CENTROIDS))
    c1, c2 = codebook(x[:, :dim // 2], k), codebook(x[:, dim // 2:], k)
    placed = cut_lineage(rows.mapInArrow(_placed(c1, c2, dim), f"{ROW}, cell int, r1 double, r2 double"))
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("r1").alias("r1"), F.max("r2").alias("r2")).toPandas().sort_values("cell")
    cell, size = cells["cell"].to_numpy(np.int64), cells["n"].to_numpy(np.int64)
    end = np.cumsum(size)
    book = {"c1": c1, "c2": c2, "dim": dim, "cell": cell, "i": cell // len(c2), "j": cell % len(c2), "r1": cells["r1"].to_numpy(float), "r2": cells["r2"].to_numpy(float),
            "from": (end - size) // LOT_ROWS, "to": (end - 1) // LOT_ROWS}
    spark = rows.sparkSession
    lots = spark.createDataFrame([(int(c), int(a), int(b - a + 1)) for c, a, b in zip(cell, book["from"], book["to"])], "cell int, first_lot int, n_lots int")
    lot = (F.col("first_lot") + F.pmod(F.xxhash64("uid"), F.col("n_lots"))).cast("int")
    return cut_lineage(placed.join(F.broadcast(lots), "cell").withColumn("lot", lot).drop("first_lot", "n_lots")), book


def half_norms(q: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.sqrt((h * h).sum(axis=-1)) for h in (q[..., :dim // 2], q[..., dim // 2:]))


def _routed(book: dict, home: bool):
    """Requests with each lot they go to: the home lot of each of their windows, or every lot with a cell whose
    bounds reach into a window above what is known."""
    half, dim = book["dim"] // 2, book["dim"]
    lot_sets = [np.arange(a, b + 1) for a, b in zip(book["from"], book["to"])]

    def f(batches):
        for b in batches:
            q = padded(b.column("v"), dim)
            with np.errstate(all="ignore"):
                middle = (q[:, :half] @ book["c1"].T)[:, book["i"]] + (q[:, half:] @ book["c2"].T)[:, book["j"]]
                n1, n2 = half_norms(q, dim)
                reach = n1[:, None] * book["r1"] + n2[:, None] * book["r2"]
                reach = reach + 1e-6 + 1e-9 * (np.abs(middle) + reach)
                top, low = np.nan_to_num(middle + reach, nan=np.inf, posinf=np.inf), np.nan_to_num(middle - reach, nan=-np.inf, neginf=-np.inf)
            row, lots = [], []
            for a, (uid, wins) in enumerate(zip(b.column("uid").to_pylist(), b.column("wins").to_pylist())):
                need = np.zeros(len(lot_sets), bool)
                for w in wins:
                    if home:
                        guess = np.nan_to_num(middle[a], nan=0)
                        need[guess.argmax() if w["hi"] == HIGH else np.abs(guess - w["hi"]).argmin()] = True
                    else:
                        need |= (top[a] >= max(w["lo"], w["known"])) & (low[a] <= w["hi"])
                at = [lot_sets[c] for c in np.flatnonzero(need)]
                at = np.unique([s[uid % len(s)] for s in at] if home else np.concatenate(at)) if at else np.zeros(0, np.int64)
                row += [a] * len(at)
                lots.append(at)
            take, n = pa.array(row, pa.int64()), len(row)
            lots = np.concatenate(lots).astype(np.int32) if lots else np.zeros(0, np.int32)
            empty = [pa.nulls(n, t) for t in (pa.int32(), pa.float64(), pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(lots), pa.array(np.ones(n, np.int32)), *[b.column(c).take(take) for c in ("uid", "vec_id", "label", "v")],
                                              *empty, b.column("wins").take(take)], VISIT_NAMES)
    return f


# ── visits ────────────────────────────────────────────────────────────

def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of integral numbers as int64; what 64 bits cannot hold becomes the nearest that they can."""
    most = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(len(q), 1)
    if most < 2**53:
        return (x @ q).astype(np.int64)
    sums = [sum(int(a) * int(b) for a, b in zip(r, q)) for r in x]
    return np.array([min(max(s, LOW), HIGH) for s in sums], np.int64)


class Lot:
    """The rows of a lot by cell, and the half bounds of its centroids."""

    def __init__(self, pieces: list[pa.RecordBatch], book: dict):
        t = pa.Table.from_batches(pieces)
        cell = t["cell"].to_numpy()
        order = np.lexsort((t["uid"].to_numpy(), cell))
        self.book, k2 = book, len(book["c2"])
        self.x = padded(t["v"], book["dim"])[order]
        self.uid, self.vec_id = (t[c].to_numpy()[order] for c in ("uid", "vec_id"))
        codes = t["label"].combine_chunks().dictionary_encode()
        self.codes, self.code = {v: i for i, v in enumerate(codes.dictionary.to_pylist())}, codes.indices.to_numpy()[order]
        cells, start = np.unique(cell[order], return_index=True)
        self.rows = {int(c): (a, b) for c, a, b in zip(cells, start, np.append(start[1:], len(order)))}
        i, j = cell // k2, cell % k2
        self.i, self.j = np.unique(i), np.unique(j)
        self.r1, self.r2 = np.zeros(len(book["c1"])), np.zeros(k2)
        np.maximum.at(self.r1, i, t["r1"].to_numpy())
        np.maximum.at(self.r2, j, t["r2"].to_numpy())

    def visit(self, q: np.ndarray, label: str, uid: int, wins: list[dict], k: int, same: bool) -> list[list[tuple]]:
        """The k first (-score, vec_id, uid) of each window, of rows with the anchor's label or with another."""
        book, half = self.book, self.book["dim"] // 2
        with np.errstate(all="ignore"):
            m1, m2 = book["c1"][self.i] @ q[:half], book["c2"][self.j] @ q[half:]
            n1, n2 = half_norms(q, book["dim"])
            r1, r2 = n1 * self.r1[self.i], n2 * self.r2[self.j]
            b1, b2 = np.nan_to_num(m1 + r1, nan=np.inf, posinf=np.inf), np.nan_to_num(m2 + r2, nan=np.inf, posinf=np.inf)
            l1, l2 = np.nan_to_num(m1 - r1, nan=-np.inf, neginf=-np.inf), np.nan_to_num(m2 - r2, nan=-np.inf, neginf=-np.inf)
            slack = np.nan_to_num(1e-6 + 1e-9 * sum(np.abs(y).max() for y in (m1, m2, r1, r2)), nan=np.inf, posinf=np.inf)
        o1, o2 = np.argsort(-b1), np.argsort(-b2)
        s1, s2, i, j = b1[o1].tolist(), b2[o2].tolist(), self.i[o1].tolist(), self.j[o2].tolist()
        l1, l2, k2, code = l1[o1].tolist(), l2[o2].tolist(), len(book["c2"]), self.codes.get(label, -1)
        best = [[] for _ in wins]
        least = [max(w["lo"], w["known"]) for w in wins]
        widest = max(w["hi"] for w in wins)

        def score(spans: list[tuple[int, int]]) -> None:
            own = np.concatenate([np.arange(lo, hi) for lo, hi in spans])
            own = own[(self.code[own] == code) == same]
            scores = products(self.x[own], q)
            for n, w in enumerate(wins):
                fits = np.flatnonzero((scores >= least[n]) & (scores <= w["hi"]))
                if same:
                    fits = fits[self.uid[own[fits]] != uid]
                if len(fits):
                    at, s = own[fits], scores[fits]
                    first = np.lexsort((self.uid[at], self.vec_id[at], -s))[:k]
                    best[n] = sorted([*best[n], *zip((-s[first]).tolist(), self.vec_id[at[first]].tolist(), self.uid[at[first]].tolist())])[:k]
                    if len(best[n]) == k:
                        least[n] = max(least[n], -best[n][-1][0])

        heap, spans, size = [(-(s1[0] + s2[0]), 0, 0)], [], 0
        while heap or spans:
            certified = not heap or -heap[0][0] + slack < min(least)       # no cell to come can enter a window
            if spans and (certified or size >= SCORED):
                score(spans)
                spans, size = [], 0
                continue
            if certified:
                break
            _, a, b = heapq.heappop(heap)
            if b + 1 < len(s2):
                heapq.heappush(heap, (-(s1[a] + s2[b + 1]), a, b + 1))
            if b == 0 and a + 1 < len(s1):
                heapq.heappush(heap, (-(s1[a + 1] + s2[0]), a + 1, 0))
            span = self.rows.get(i[a] * k2 + j[b])
            if span is not None and l1[a] + l2[b] - slack <= widest:
                spans.append(span)
                size += span[1] - span[0]
        return best


FOUND = "anchor long, no int, score long, vec_id long, uid long"


def _visited(book: dict, k: int, same: bool):
    schema = pa.schema([("anchor", pa.int64()), ("no", pa.int32()), ("score", pa.int64()), ("vec_id", pa.int64()), ("uid", pa.int64())])

    def answers(lot: Lot, requests: pa.RecordBatch) -> pa.RecordBatch:
        q, out = padded(requests.column("v"), book["dim"]), []
        for x, uid, label, wins in zip(q, *[requests.column(c).to_pylist() for c in ("uid", "label", "wins")]):
            for w, best in zip(wins, lot.visit(x, label, uid, wins, k, same)):
                out += [(uid, w["no"], -s, vec_id, other) for s, vec_id, other in best]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 5, schema)], schema=schema)

    def f(batches):
        """Rows come lot by lot, a lot's own before the requests; requests are answered batch by batch."""
        now, pieces, lot = None, [], None
        for b in batches:
            where, kind = b.column("lot").to_numpy(), b.column("kind").to_numpy()
            cuts = np.flatnonzero(np.append(True, (where[1:] != where[:-1]) | (kind[1:] != kind[:-1]))) if len(where) else []
            for lo, hi in zip(cuts, [*cuts[1:], len(where)]):
                if where[lo] != now:
                    now, pieces, lot = where[lo], [], None
                if kind[lo] == 0:
                    pieces.append(b.slice(lo, hi - lo))
                else:
                    lot = lot or Lot(pieces, book)
                    yield answers(lot, b.slice(lo, hi - lo))
    return f


def search(index: DataFrame, book: dict, anchors: DataFrame, windows: DataFrame, k: int, same: bool) -> DataFrame:
    """(anchor, no, score, vec_id, uid, rank): for each window (uid, no, lo, hi) of an anchor, its first k rows with
    a score from lo to hi, by falling score, then vec_id; of the anchor's label (itself not) or of other labels."""
    known = windows.sparkSession.createDataFrame([], "uid long, no int, known long")
    lots = int(book["to"].max()) + 1
    rows = index.select("lot", F.lit(0).alias("kind"), "uid", "vec_id", "label", "v", "cell", "r1", "r2").withColumn("wins", F.lit(None).cast(WINS[5:]))
    for home in (True, False):
        wins = windows.join(known, ["uid", "no"], "left").withColumn("known", F.coalesce("known", F.lit(LOW)))
        wins = wins.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("no", "lo", "hi", "known"))).alias("wins"))
        requests = anchors.join(wins, "uid").mapInArrow(_routed(book, home), VISIT)
        found = (rows.unionByName(requests).repartition(min(lots, TASKS), "lot").sortWithinPartitions("lot", "kind")
                 .mapInArrow(_visited(book, k, same), FOUND))
        order = W.partitionBy("anchor", "no").orderBy(F.col("score").desc(), "vec_id", "uid")
        best = cut_lineage(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
        known = best.where(F.col("rank") == k).select(F.col("anchor").alias("uid"), "no", F.col("score").alias("known"))
    return best


# ── mining ────────────────────────────────────────────────────────────

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def scored_rows(vectors: DataFrame, key: str, vector: str, label: str, scale: int) -> DataFrame:
    """(uid, vec_id, label, v) of the rows that take part; a component x is floor(scale * x)."""
    x = F.transform(F.col(vector).cast("array<double>"), lambda y: y * scale)
    whole = F.transform("x", lambda y: F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y))
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), x.alias("x"))
    fine = F.forall("x", lambda y: F.coalesce(F.abs(y) < float("inf"), F.lit(False))) & (F.size("x") > 0)
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fine, F.lit(False)))
    return cut_lineage(rows.select(F.monotonically_increasing_id().alias("uid"), "vec_id", "label", whole.alias("v")))


def hard_negatives(vectors: DataFrame, anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows where ``anchor`` (a condition on ``vec_id``) holds. An anchor's positives are its first
    POSITIVES other rows of its label by inner product, then id; for each, the first NEGATIVES rows of other labels
    whose score is from 50 to 95 percent of the positive's. A positive with a negative score has no such rows.

    Rows with a null id, label or vector, without components, or with a null or non-finite component (also after
    scaling) take no part. A shorter vector counts as filled up with zeros. Rows are told apart by place, so repeated
    rows count each, and a row is never its own positive. Scores beyond 64 bits become the nearest 64-bit number.
    Other columns are not read."""
    spark = vectors.sparkSession
    rows = scored_rows(vectors, key, vector, label, scale)
    found = multi_index(rows)
    if found is None:
        return spark.createDataFrame([], RESULT)
    index, book = found
    anchors = rows.where(anchor)
    all_scores = anchors.select("uid", F.lit(0).alias("no"), F.lit(LOW).alias("lo"), F.lit(HIGH).alias("hi"))
    positives = search(index, book, anchors, all_scores, POSITIVES, True)
    p = F.col("score")
    windows = positives.where(p >= 0).select(F.col("anchor").alias("uid"), F.col("rank").alias("no"), (p - F.expr("score div 2")).alias("lo"),
                                             (p - F.expr("score div 20") - (p % 20 > 0).cast("long")).alias("hi"))
    negatives = search(index, book, anchors, windows, NEGATIVES, False)
    out = negatives.select("anchor", F.col("no").alias("of"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = out.join(positives.select(F.col("anchor").alias("a"), F.col("rank").alias("r"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")),
                   (F.col("anchor") == F.col("a")) & (F.col("of") == F.col("r")))
    out = out.join(anchors.select(F.col("uid").alias("u"), F.col("vec_id").alias("anchor_id")), F.col("anchor") == F.col("u"))
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


ORACLE = r"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL
    AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
    FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, (row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b))::INTEGER AS rank, s.b AS negative_id,
    p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
QUALIFY row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) <= 3
"""
