"""Prefix trie of conversations: range minima over the common prefixes of sorted sequences.

A conversation is the sequence of its turns' 16-byte digests; equal conversations are one row with a count. The
distinct sequences are sorted over the cluster (range partitions, called lots), so the conversations that begin with a
prefix are an interval. In a lot, neighbours' common prefix lengths get a sparse table of range minima. Each candidate
prefix (the first sequence that has it, and its length) finds its left and right extent by two independent binary
searches over that table, and all its numbers are sums or minima over the interval. A lot knows the sequences next to
it, so a prefix that reaches over a lot's edge gives partial numbers, which add up in one aggregate."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorekit.session import cut_lineage

HEAD = 4                         # a conversation takes fewer first turns than this from another
GROUP = 20
LOT_BYTES = 4 << 20              # of digests and word counts in a lot
ID_SPAN = 1 << 11                # member ids joined to one text at a time
DIGEST = 16
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
WORD = r"[^\x20\x09-\x0D]+"


# ── sequences ─────────────────────────────────────────────────────────

def turn_rows(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, pos from 1, digest, words) of each turn in order: by turn (null first), then role, then text."""
    role_, text_ = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = turns.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"),
                                                       role_.alias("role"), text_.alias("text"))
    pos = F.row_number().over(W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    digest = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))))
    return rows.select("conv_id", pos.alias("pos"), digest.alias("digest"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))


def sequences(rows: DataFrame) -> DataFrame:
    """(conv_id, turns array of (pos, digest, words) in order) of ``turn_rows``."""
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "words"))).alias("turns"))


def head_length(conv: Column) -> Column:
    return (F.crc32(conv.cast("string")) % HEAD).cast("int")


def rebuilt(convs: DataFrame) -> DataFrame:
    """``sequences`` with the first h turns of conversation c - c % GROUP in place of a conversation's own first h;
    h is crc32(c) % HEAD. A missing donor gives none, a short one all it has."""
    donors = convs.where(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("donor"), F.slice("turns", 1, HEAD - 1).alias("head"))
    c = convs.withColumn("donor", F.col("conv_id") - F.col("conv_id") % GROUP).withColumn("h", head_length(F.col("conv_id")))
    c = c.join(donors, "donor", "left")
    none = F.slice("turns", 1, 0)
    own = F.expr("slice(turns, h + 1, greatest(size(turns) - h, 0))")
    return c.select("conv_id", F.concat(F.coalesce(F.expr("slice(head, 1, h)"), none), own).alias("turns"))


# ── members of equal sequences ────────────────────────────────────────

def _hash_lists(batches):
    """(seq, ends) from rows (seq, part, ids) sorted by both: one running digest, so a group of any size is read in
    pieces of ID_SPAN ids at most."""
    seq, h, out = None, None, []
    for batch in batches:
        for s, ids in zip(batch.column("seq").to_pylist(), batch.column("ids").to_pylist()):
            if s != seq:
                if seq is not None:
                    out.append((seq, h.hexdigest()))
                seq, h = s, hashlib.sha256(ids.encode())
            else:
                h.update(b"," + ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out])], ["seq", "ends"])
            out = []
    if seq is not None:
        yield pa.RecordBatch.from_arrays([pa.array([seq], pa.binary()), pa.array([h.hexdigest()])], ["seq", "ends"])


def member_digests(members: DataFrame) -> DataFrame:
    """(seq, ends): SHA-256 of the conv_ids of each sequence, ascending, joined by commas."""
    part = F.floor(F.col("conv_id") / ID_SPAN)
    lists = members.groupBy("seq", part.alias("part")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
    return (lists.repartition("seq").sortWithinPartitions("seq", "part").select("seq", "ids")
            .mapInArrow(_hash_lists, "seq binary, ends string"))


# ── range minima ──────────────────────────────────────────────────────

def sparse_table(values: np.ndarray) -> list[np.ndarray]:
    """levels[k][i] = smallest of values[i .. i + 2^k)."""
    levels = [values]
    while 2 * (span := 1 << (len(levels) - 1)) <= len(values):
        last = levels[-1]
        levels.append(np.minimum(last[:-span], last[span:]))
    return levels


def range_min(levels: list[np.ndarray], lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Smallest of values[lo .. hi] for each pair."""
    k = np.frexp((hi - lo + 1).astype(float))[1] - 1
    out = np.empty(len(lo), levels[0].dtype)
    for level in np.unique(k):
        m = k == level
        out[m] = np.minimum(levels[level][lo[m]], levels[level][hi[m] - (1 << int(level)) + 1])
    return out


def right_extent(levels: list[np.ndarray], start: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Last row r >= start such that each lcp[j] between neighbours j and j + 1 of start..r is at least depth."""
    r = start.copy()
    for k in range(len(levels) - 1, -1, -1) if len(levels[0]) else ():
        fits = r + (1 << k) <= len(levels[0])
        at = np.where(fits, r, 0)
        r = np.where(fits & (levels[k][np.minimum(at, len(levels[k]) - 1)] >= depth), r + (1 << k), r)
    return r


def left_extent(levels: list[np.ndarray], start: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """First row l <= start such that each lcp between neighbours of l..start is at least depth."""
    left = start.copy()
    for k in range(len(levels) - 1, -1, -1) if len(levels[0]) else ():
        at = left - (1 << k)
        left = np.where((at >= 0) & (levels[k][np.clip(at, 0, len(levels[k]) - 1)] >= depth), at, left)
    return left


def common(a: bytes, b: bytes | None) -> int:
    """Digests that two sequences begin with in common; -1 without a second one."""
    if b is None:
        return -1
    n = min(len(a), len(b))
    x, y = np.frombuffer(a[:n], np.uint8), np.frombuffer(b[:n], np.uint8)
    differ = np.flatnonzero(x != y)
    return (int(differ[0]) if len(differ) else n) // DIGEST


NODES = ("node binary, parent binary, open boolean, parent_open boolean, depth int, conv_id long, parent_conv_id long, n_convs long, "
         "n_children long, n_leaves long, token_mass long, node_mass long, ends string")


def lot_nodes(rows: pa.Table, before: bytes | None, after: bytes | None) -> pa.Table:
    """The trie nodes of one lot. rows: (seq, words, conv_id, copies, ends), distinct sequences. before, after: the
    last sequence of the lot before and the first of the one after. A node that may have members in another lot is
    ``open``: it comes with its key and what this lot adds to it."""
    rows = rows.take(pc.sort_indices(rows["seq"]))
    seqs = rows["seq"].to_pylist()
    m = len(seqs)
    copies, conv = rows["copies"].to_numpy(), rows["conv_id"].to_numpy()
    words = rows["words"].combine_chunks()
    length = np.diff(words.offsets.to_numpy()).astype(np.int64)
    base = np.cumsum(length) - length                                  # first turn of each sequence
    run = np.append(0, np.cumsum(words.flatten().to_numpy(zero_copy_only=False))).astype(np.int64)
    total = run[base + length] - run[base]
    digests = np.frombuffer(b"".join(seqs), np.uint64).reshape(-1, 2)

    # common prefix of each sequence with the next one
    short = np.minimum(length[:-1], length[1:])
    lcp = short.copy()
    step = np.cumsum(short) - short
    flat = np.arange(short.sum()) - np.repeat(step, short)
    differ = np.flatnonzero((digests[np.repeat(base[:-1], short) + flat] != digests[np.repeat(base[1:], short) + flat]).any(axis=1))
    np.minimum.at(lcp, np.repeat(np.arange(m - 1), short)[differ], flat[differ])
    first, last = common(seqs[0], before), common(seqs[-1], after)
    back, ahead = np.append(first, lcp), np.append(lcp, last)          # with the sequence before, after
    table = sparse_table(lcp)

    # candidates: the first sequence in this lot with each prefix; of the lot's first sequence, all its prefixes
    known = back.copy()
    known[0] = -1
    n = length - known
    row = np.repeat(np.arange(m), n)
    depth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + known[row] + 1
    slot = np.cumsum(n) - n - known - 1                                # candidate of (row, depth) = slot[row] + depth
    left, right = left_extent(table, row, depth), right_extent(table, row, depth)
    span = lambda values: np.append(0, np.cumsum(values))              # noqa: E731
    over = lambda sums, lo: sums[right + 1] - sums[lo]                 # noqa: E731
    n_convs = over(span(copies), left)
    prefix_words = run[base[row] + np.maximum(depth - 1, 0)] - run[base[row]]
    token_mass = over(span(copies * total), left) - prefix_words * n_convs
    new_from = np.maximum(back, 0)                                     # turns that the sequence before has too
    new = total - (run[base + new_from] - run[base])
    own_from = np.maximum(np.maximum(depth - 1, back[row]), 0)
    node_mass = over(span(new), row + 1) + run[base[row] + length[row]] - run[base[row] + own_from]
    n_leaves = over(span(ahead < length), left)
    smallest = range_min(sparse_table(conv), left, right)

    # children: each prefix that is new in its row adds one to the prefix one shorter
    fresh = np.flatnonzero((depth > 0) & (depth > back[row]))
    kin_row, kin_depth = row[fresh], depth[fresh] - 1
    owner = left_extent(table, kin_row, kin_depth)
    n_children = np.bincount(slot[owner] + kin_depth, minlength=len(row))

    is_open = ((row == 0) & (depth <= first)) | ((right == m - 1) & (depth <= last))
    up = np.maximum(depth - 1, 0)
    mother = slot[left_extent(table, row, up)] + up
    mother_open = is_open[mother] & (depth > 0)
    ends = np.where(depth == length[row], rows["ends"].to_numpy(zero_copy_only=False)[row], EMPTY_SHA)

    def keys(need: np.ndarray, of: np.ndarray) -> pa.Array:
        out = [None] * len(need)
        for i in np.flatnonzero(need):
            out[i] = hashlib.md5(seqs[row[i]][:int(of[i]) * DIGEST]).digest()
        return pa.array(out, pa.binary())
    return pa.table([keys(is_open, depth), keys(mother_open, up), pa.array(is_open), pa.array(mother_open), pa.array(depth.astype(np.int32)),
                     pa.array(smallest), pa.array(smallest[mother], mask=(depth == 0) | mother_open), pa.array(n_convs),
                     pa.array(n_children.astype(np.int64)), pa.array(n_leaves.astype(np.int64)), pa.array(token_mass), pa.array(node_mass),
                     pa.array(ends, pa.string())],
                    names=[c.split()[0] for c in NODES.split(", ")])


def _lot(rows: pa.Table, edge: pa.Table) -> pa.Table:
    return lot_nodes(rows, *(edge[c][0].as_py() for c in ("before", "after")))


# ── the trie ──────────────────────────────────────────────────────────

def prefix_trie(convs: DataFrame, lot_bytes: int = LOT_BYTES) -> DataFrame:
    """One row per distinct prefix of the sequences of ``convs`` (conv_id, turns): conv_id (smallest member), depth,
    parent_conv_id (null for the root), n_convs, n_children, n_leaves (of its subtree), saved_tokens (of its subtree:
    words of a node's last turn for each member but one), ends_sha256 (of the ids that end there).

    A conversation without turns is a member of the root alone. No conversations, no rows: there is no root without
    a member. A conversation is one array of 24 bytes a turn, so the longest one bounds a task's memory from below."""
    members = cut_lineage(convs.select("conv_id", F.expr("array_join(transform(turns, t -> hex(t.digest)), '')").alias("hexed"), "turns").select(
        "conv_id", F.unhex("hexed").alias("seq"), F.transform("turns", lambda t: t["words"]).alias("words")))
    distinct = members.groupBy("seq").agg(F.first("words").alias("words"), F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"))
    distinct = distinct.join(member_digests(members.select("seq", "conv_id")), "seq")
    size = members.select(F.sum(F.length("seq") * 1.5 + 64)).first()[0] or 0
    lots = max(1, int(-(-size // lot_bytes)))
    placed = cut_lineage(distinct.repartitionByRange(lots, "seq").withColumn("lot", F.spark_partition_id()))

    # one row per lot: what stands on its two sides
    edges = placed.groupBy("lot").agg(F.min("seq").alias("low"), F.max("seq").alias("high"))
    order = W.orderBy("lot")
    edges = edges.select("lot", F.lag("high").over(order).alias("before"), F.lead("low").over(order).alias("after"))
    nodes = cut_lineage(placed.groupBy("lot").cogroup(edges.groupBy("lot")).applyInArrow(_lot, NODES))

    numbers = ["n_convs", "n_children", "n_leaves", "token_mass", "node_mass"]
    merged = nodes.where("open").groupBy("node").agg(
        F.first("parent").alias("parent"), F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in numbers],
        F.coalesce(F.max(F.when(F.col("ends") != EMPTY_SHA, F.col("ends"))), F.lit(EMPTY_SHA)).alias("ends"))
    merged = cut_lineage(merged)
    mothers = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("up"))
    at = ["depth", "conv_id", *numbers, "ends"]
    inner = nodes.where("NOT open AND NOT parent_open").select(*at, "parent_conv_id")
    below = nodes.where("NOT open AND parent_open").select(*at, "parent").unionByName(merged.select(*at, "parent"))
    below = below.join(mothers, "parent", "left").select(*at, F.col("up").alias("parent_conv_id"))
    out = inner.unionByName(below)
    return out.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves",
                      (F.col("token_mass") - F.col("node_mass")).alias("saved_tokens"), F.col("ends").alias("ends_sha256"))


def conversation_trie(turns: DataFrame, lot_bytes: int = LOT_BYTES) -> DataFrame:
    """``prefix_trie`` of the rebuilt conversations of a table (conv_id, turn, role, text).

    Turns stand in the order of turn, null first; equal ones by role, then text. A null role or text is an empty one.
    Rows without conv_id belong to no conversation. Repeated rows are turns of their own. Other columns are not read."""
    return prefix_trie(rebuilt(cut_lineage(sequences(turn_rows(turns)))), lot_bytes)


#: Rebuilt conversations as lists of turns; each prefix is a list, and a subtree is what starts with it.
ORACLE = r"""
WITH codes AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
    lambda a, k: xor(a >> 1, (a & 1) * 3988292384))) AS code),
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
    length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS x,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS w FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list(md5(x) ORDER BY pos) AS xs, list(w ORDER BY pos) AS ws FROM t GROUP BY conv_id),
h AS (SELECT conv_id, xs, ws, conv_id - conv_id % 20 AS donor, xor(list_reduce(list_concat([4294967295],
    list_transform(string_split(conv_id::VARCHAR, ''), lambda z: ascii(z)::BIGINT)),
    lambda a, b: xor(a >> 8, code[xor(a & 255, b) + 1])), 4294967295) % 4 AS h FROM c, codes),
r AS (SELECT h.conv_id, list_concat(coalesce(d.xs[1:h.h], []), h.xs[h.h + 1:]) AS xs, list_concat(coalesce(d.ws[1:h.h], []), h.ws[h.h + 1:]) AS ws
    FROM h LEFT JOIN c d ON d.conv_id = h.donor),
p AS (SELECT conv_id, d, xs[1:d] AS pre, CASE WHEN d > 0 THEN ws[d] ELSE 0 END AS w, d = len(xs) AS at_end
    FROM (SELECT *, unnest(range(0, len(xs) + 1)) AS d FROM r)),
n AS (SELECT pre, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(w) AS w,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE at_end), '')) AS ends_sha256 FROM p GROUP BY pre, d),
k AS (SELECT pre[1:d - 1] AS pre, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
f AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k ON n.pre = k.pre AND n.d = k.d),
s AS (SELECT pre[1:e] AS pre, e AS d, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * w) AS saved
    FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM f) GROUP BY ALL)
SELECT f.conv_id, f.d::BIGINT AS depth, m.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved::BIGINT AS saved_tokens, f.ends_sha256
FROM f JOIN s ON f.pre = s.pre AND f.d = s.d LEFT JOIN f m ON f.d > 0 AND m.pre = f.pre[1:f.d - 1] AND m.d = f.d - 1
"""
