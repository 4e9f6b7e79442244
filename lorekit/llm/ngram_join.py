"""Similarity join on word shingles with adaptive multi-match prefixes.

A document's set is its distinct shingles of ``shingle`` words (64-bit hashes); equal sets are one class. Shingles are
ordered from rare to frequent by a counting sketch of all documents (2^22 counters, so its broadcast size is
fixed). Two sets with Jaccard >= t share at least l shingles among the first n - ceil(t n) + l of each, for any l.
Each document takes the l (up to ``MAX_MATCHES``) with the least estimated cost: the postings of the longer prefix
against the candidates left when l shared shingles are asked for. A pair needs the smaller l of its two documents.

No group becomes all its pairs. Documents that share a frequent prefix shingle are compared in blocks in memory.
Through the others every class is first verified against the smallest class that shares its prefix best, and linked
classes are contracted; then pairs of classes that still lie in different components are verified. Links within a
component cannot change it."""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekit.llm.embedding_dedup import spanning
from lorekit.llm.passages import chunk_count
from lorekit.llm.textblocks import MIX2, mix, prefix_hash, ragged, range_hash, text_blocks, word_hashes, word_spans
from lorekit.operators.components import components
from lorekit.session import cut_lineage, free_shuffles, stage_path

SHINGLE, PERCENT = 3, 90
MAX_MATCHES = 4
VERIFY_COST = 20.0               # a verification against a posting read
SKETCH_BITS, SKETCH_PARTS = 22, 64
HOT = 64                         # documents behind a prefix token that are compared in blocks
BLOCK, BLOCK_BYTES, COLUMNS = 1024, 8 << 20, 2048
LEVEL_CODE, BLOCK_CODE = 1 << 20, 1 << 31
LOT_ROWS, LOT_BYTES = 4096, 24 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32


def row_sets(offsets: np.ndarray, raw: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of a block's rows, sorted by row and hash."""
    raw = LOWER[raw]
    start, end, before = word_spans(offsets, raw)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    prefix = prefix_hash(word_hashes(raw, start, end))
    words = np.diff(before)
    count = np.where(words > 0, np.maximum(words - shingle + 1, 1), 0)
    row = np.repeat(np.arange(len(words)), count)
    first = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + before[:-1][row]
    h = range_hash(prefix, first, np.minimum(first + shingle, before[1:][row]))
    order = np.argsort(h)
    order = order[np.argsort(row[order].astype(np.uint32) if len(words) >= 1 << 16 else row[order].astype(np.uint16), kind="stable")]
    row, h = row[order], h[order]
    new = np.append(True, (row[1:] != row[:-1]) | (h[1:] != h[:-1]))
    return row[new], h[new]


def count_sketch(shingle: int = SHINGLE):
    """(part, counters) of how many documents of the task have a shingle of each counter, 65,535 at most."""
    def f(batches):
        total = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            for _, offsets, raw in text_blocks(batch.column(0)):
                _, h = row_sets(offsets, raw, shingle)
                at, n = np.unique(h >> np.uint64(64 - SKETCH_BITS), return_counts=True)
                total[at] += n.astype(np.uint32)
        size = len(total) // SKETCH_PARTS
        total = np.minimum(total, 2**16 - 1).astype(np.uint16)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SKETCH_PARTS, dtype=np.int32)), pa.array(
            [total[i * size:(i + 1) * size].tobytes() for i in range(SKETCH_PARTS)], pa.binary())], ["part", "counters"])
    return f


def add_sketches(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_buffer(), np.uint16).astype(np.uint64) for x in table["counters"])
    total = np.minimum(total, 2**32 - 1).astype(np.uint32)
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "counters": pa.array([total.tobytes()], pa.binary())})


def document_counts(texts: DataFrame, shingle: int = SHINGLE) -> np.ndarray:
    """Counters over all documents: 16 MB, whatever the input."""
    parts = (texts.mapInArrow(count_sketch(shingle), "part int, counters binary").groupBy("part")
             .applyInArrow(add_sketches, "part int, counters binary").collect())
    by = {r.part: np.frombuffer(r.counters, np.uint32) for r in parts}
    empty = np.zeros((1 << SKETCH_BITS) // SKETCH_PARTS, np.uint32)
    return np.concatenate([by.get(i, empty) for i in range(SKETCH_PARTS)])


def needed(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Smallest overlap that a set of n can have with a set similar enough."""
    return (percent * n + 99) // 100


def prefixes(row: np.ndarray, h: np.ndarray, counts: np.ndarray, percent: int = PERCENT):
    """Rarest-first prefixes: (sets' rows, sizes, l, prefix lengths, concatenated prefix hashes)."""
    df = counts[h >> np.uint64(64 - SKETCH_BITS)]
    order = np.lexsort((h, df, row))
    h, df = h[order], df[order].astype(np.float64)
    rows, start, n = np.unique(row, return_index=True, return_counts=True)
    usual = max(float(counts.mean()), 1.0)                      # what other shingles add to a counter
    seen = np.concatenate([[0.0], np.cumsum(np.maximum(df - usual, 0.0))])
    base = n - needed(n, percent)
    best, matches = np.full(len(n), np.inf), np.ones(len(n), np.int64)
    for k in range(1, MAX_MATCHES + 1):
        size = base + k
        met = seen[start + np.minimum(size, n)] - seen[start]
        cost = np.where(size <= n, met * (1 + VERIFY_COST / k) + size, np.inf)
        matches = np.where(cost < best, k, matches)
        best = np.minimum(best, cost)
    size = base + matches
    take = np.repeat(start, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return rows, n, matches, size, h[take]


def set_rows(counts, percent: int = PERCENT, shingle: int = SHINGLE):
    """(doc_id, n, h1, h2, matches, prefix) of every document."""
    def f(batches):
        names = ["doc_id", "n", "h1", "h2", "matches", "prefix"]
        for batch in batches:
            for lo, offsets, raw in text_blocks(batch.column("text")):
                k = len(offsets) - 1
                row, h = row_sets(offsets, raw, shingle)
                n, m = np.bincount(row, minlength=k).astype(np.int64), np.ones(k, np.int32)
                h1, h2, length = np.zeros(k, np.uint64), np.zeros(k, np.uint64), np.zeros(k, np.int64)
                flat = np.zeros(0, np.uint64)
                if len(row):
                    at = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                    rows, _, mm, size, flat = prefixes(row, h, counts.value, percent)
                    h1[rows] = np.add.reduceat(mix(h), at)
                    h2[rows] = np.add.reduceat(mix(h * MIX2), at)
                    m[rows], length[rows] = mm, size
                cut = pa.array(np.append(0, np.cumsum(length)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, k), pa.array(n), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)),
                     pa.array(m), pa.ListArray.from_arrays(cut, pa.array(flat.view(np.int64)))], names)
    return f


def similar_rows(percent: int = PERCENT, shingle: int = SHINGLE):
    """The pairs (a, b) of rows (a, b, text_a, text_b) whose whole sets are similar enough."""
    def f(batches):
        for batch in batches:
            a, b = batch.column("text_a"), batch.column("text_b")
            n = batch.num_rows
            if not n:
                continue
            both = pa.concat_arrays([a, b]).take(pa.array(np.arange(2 * n).reshape(2, n).T.ravel()))
            pending: list = []
            size, shared = np.zeros(2 * n, np.int64), np.zeros(n, np.int64)
            for lo, offsets, raw in text_blocks(both):
                row, h = row_sets(offsets, raw, shingle)
                row = row + lo
                size += np.bincount(row, minlength=2 * n)
                if pending:                                    # a pair may begin in the block before
                    row, h = np.concatenate([pending[0], row]), np.concatenate([pending[1], h])
                end = lo + len(offsets) - 1
                open_row = row >= end - 1 if end % 2 else np.zeros(len(row), bool)
                pending = [row[open_row], h[open_row]]
                pair, h = row[~open_row] // 2, h[~open_row]
                order = np.lexsort((h, pair))
                pair, h = pair[order], h[order]
                twice = (pair[1:] == pair[:-1]) & (h[1:] == h[:-1])
                shared += np.bincount(pair[1:][twice], minlength=n)
            union = size[0::2] + size[1::2] - shared
            yield batch.select(["a", "b"]).filter(pa.array((union > 0) & (100 * shared >= percent * union)))
    return f


def block_links(percent: int = PERCENT, shingle: int = SHINGLE):
    """Links between the rows of each (group, pair of blocks), by matrix products over the shingles they share."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def f(table: pa.Table) -> pa.Table:
        ids, group, other, block = (table[c].to_numpy() for c in ("doc_id", "group", "other", "block"))
        parts = [(row + lo, h) for lo, o, raw in text_blocks(table["text"]) for row, h in [row_sets(o, raw, shingle)]]
        row, h = (np.concatenate(c) for c in zip(*parts))
        begin = np.searchsorted(row, np.arange(len(ids) + 1))
        order = np.lexsort((ids, other, group))
        edge = np.flatnonzero(np.append(True, (group[order][1:] != group[order][:-1]) | (other[order][1:] != other[order][:-1])))
        out = []
        for lo, hi in zip(edge, np.append(edge[1:], len(order))):
            rows = order[lo:hi]
            a, b = divmod(int(other[rows[0]]), BLOCK_CODE)
            one, two = np.flatnonzero(block[rows] == a), np.flatnonzero(block[rows] == b)
            size = begin[rows + 1] - begin[rows]
            who = np.repeat(np.arange(len(rows)), size)
            _, col, count = np.unique(h[ragged(begin[rows], size)], return_inverse=True, return_counts=True)
            who, col = who[count[col] > 1], (np.cumsum(count > 1) - 1)[col[count[col] > 1]]
            by_col = np.argsort(col, kind="stable")
            who, col = who[by_col], col[by_col]
            shared = np.zeros((len(one), len(two)), np.float32)
            for c in range(0, int((count > 1).sum()), COLUMNS):
                x, y = np.searchsorted(col, [c, c + COLUMNS])
                m = np.zeros((len(rows), COLUMNS), np.float32)
                m[who[x:y], col[x:y] - c] = 1
                shared += m[one] @ m[two].T
            i, j = np.nonzero(100 * shared >= percent * (size[one][:, None] + size[two][None, :] - shared))
            i, j = one[i], two[j]
            root = spanning(i, j, len(rows))
            hit = np.flatnonzero(root != np.arange(len(rows)))
            out.append((ids[rows][hit], ids[rows][root[hit]]))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 2
        return pa.table([pa.array(c, pa.int64()) for c in cols], schema)
    return f


def block_places(members: DataFrame, percent: int) -> DataFrame:
    """(doc_id, group, bytes, block, other): every pair of blocks that each member (doc_id, group, n, bytes) belongs to.

    A group is cut by the sets' size n first: sets that are similar enough lie in one level or in two neighbouring ones.
    A level is cut into blocks of at most ``BLOCK`` members or ``BLOCK_BYTES`` on average, by a hash of the id. Blocks of
    levels further apart never meet, so a group's work is that of its levels, not the square of the group."""
    step = math.log(1.001 * 100 / percent)
    m = cut_lineage(members.withColumn("level", F.floor(F.log("n") / step)))
    cells = m.groupBy("group", "level").agg(F.count(F.lit(1)).alias("size"), F.sum("bytes").alias("sum"))
    cells = cut_lineage(cells.select("group", "level", F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("sum") / BLOCK_BYTES), F.lit(1)).alias("blocks")))
    near = lambda up: cells.select("group", (F.col("level") - up).alias("level"), F.col("blocks").alias(f"at{up + 1}"))
    for up in (-1, 0, 1):
        m = m.join(near(up), ["group", "level"], "left")
    m = m.withColumn("block", F.col("level") * LEVEL_CODE + F.pmod(F.xxhash64("doc_id"), F.col("at1")))

    def others(up: int):
        count = F.col(f"at{up + 1}")
        block = lambda i: (F.col("level") + up) * LEVEL_CODE + i
        pair = lambda i: F.least("block", block(i)) * F.lit(BLOCK_CODE) + F.greatest("block", block(i))
        return F.when(count > 0, F.transform(F.sequence(F.lit(0).cast("long"), count - 1), pair)).otherwise(F.array().cast("array<bigint>"))
    return m.select("doc_id", "group", "bytes", "block", F.explode(F.concat(*[others(up) for up in (-1, 0, 1)])).alias("other"))


def hot_links(posts: DataFrame, texts: DataFrame, percent: int, shingle: int = SHINGLE) -> DataFrame:
    """Links between documents that share a hot prefix token, as a spanning set.

    Hot tokens that meet in a document form a group, so a document is in one group. ``block_places`` deals a group's
    members to pairs of blocks; each pair is compared in memory, and no pair of documents becomes a row. Lots of pairs
    are sized by the bytes that are sent."""
    tokens = posts.select("token", "doc_id", "n")
    least = tokens.groupBy("doc_id").agg(F.min("token").alias("a"), F.min("n").alias("n"))
    groups = components(tokens.join(least.select("doc_id", "a"), "doc_id").select("a", F.col("token").alias("b")).distinct())
    members = least.join(groups.select(F.col("node").alias("a"), "component"), "a", "left").join(texts.select("doc_id", "bytes"), "doc_id")
    m = cut_lineage(block_places(members.select("doc_id", F.coalesce("component", "a").alias("group"), "n", "bytes"), percent))
    sent, rows = m.agg(F.sum("bytes"), F.count(F.lit(1))).first()
    lots = max(1, -(-rows // LOT_ROWS), -(-(sent or 0) // LOT_BYTES))
    m = m.drop("bytes").join(texts.select("doc_id", "text"), "doc_id").withColumn("lot", F.pmod(F.xxhash64("group", "other"), F.lit(lots)))
    return m.groupBy("lot").applyInArrow(lambda table: block_links(percent, shingle)(table.drop_columns(["lot"])), "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, percent: int, shingle: int = SHINGLE) -> DataFrame:
    """The pairs (a, b) that are similar enough by their whole texts."""
    of = lambda c: texts.select(F.col("doc_id").alias(c), F.col("text").alias("text_" + c))
    joined = pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b")
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(similar_rows(percent, shingle), "a long, b long")


def text_table(docs: DataFrame, wanted: DataFrame, parts: int) -> DataFrame:
    """(doc_id, text, bytes) of the wanted ids, bucketed by id, so that joins by id do not shuffle the texts again."""
    spark = docs.sparkSession
    name = f"lorekit_texts_{uuid.uuid4().hex}"
    path = stage_path(spark, "texts")
    rows = docs.repartition(parts, "doc_id").join(wanted.hint("shuffle_hash"), "doc_id", "left_semi")
    rows = rows.withColumn("bytes", F.octet_length("text").cast("long"))
    rows.write.option("path", path).option("compression", "zstd").bucketBy(parts, "doc_id").format("parquet").saveAsTable(name)
    return spark.table(name)


def similar_edges(docs: DataFrame, sets: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """Verified (a, b) links that give the components of the classes in ``sets`` (doc_id, n, matches, prefix).

    Documents that share a hot token are compared in blocks. The others are compared through their cold tokens, at
    most ``HOT`` documents each: first every document with the smallest that shares most with it, if that looks
    similar enough; then the pairs that still lie in different components. A pair is verified if it shares enough
    prefix tokens, at places that leave enough overlap."""
    posts = sets.select("doc_id", F.posexplode("prefix").alias("pos", "token"))
    shared = posts.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    posts = cut_lineage(posts.join(shared, "token").join(sets.select("doc_id", "n", "matches"), "doc_id"))
    ids = cut_lineage(posts.select("doc_id").distinct())
    free_shuffles(docs.sparkSession)
    texts = text_table(docs, ids, chunk_count(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0))
    free_shuffles(docs.sparkSession)
    hot = cut_lineage(hot_links(posts.where(F.col("df") > HOT), texts, percent, shingle))

    def enough(overlap):
        return (100 + percent) * overlap >= percent * (F.col("n") + F.col("n_b"))

    def candidates(rows: DataFrame) -> DataFrame:
        """(a, b, met) of rows (doc_id, pos, n, matches, and the same of the other with _b), one per shared token."""
        pairs = rows.groupBy(F.col("doc_id").alias("a"), F.col("doc_id_b").alias("b"), "n", "n_b").agg(
            F.count(F.lit(1)).alias("met"), F.min(F.least("matches", "matches_b")).alias("asked"),
            F.max("pos").alias("pos"), F.max("pos_b").alias("pos_b"))
        left = F.least(F.col("n") - F.col("pos") - 1, F.col("n_b") - F.col("pos_b") - 1)
        return pairs.where((F.col("met") >= F.col("asked")) & enough(F.col("met") + left)).select("a", "b", "met")

    cold = posts.where(F.col("df") <= HOT).drop("df")
    fields = ["doc_id", "pos", "n", "matches"]
    first = cold.groupBy("token").agg(F.min(F.struct(*fields)).alias("f")).select("token", *[F.col("f")[c].alias(c + "_b") for c in fields])
    met = candidates(cold.join(first, "token").where("doc_id <> doc_id_b"))
    best = met.groupBy("a").agg(F.max(F.struct("met", (-F.col("b")).alias("b"))).alias("best"))
    stars = best.select("a", (-F.col("best.b")).alias("b"))
    links = hot.unionAll(cut_lineage(verified(stars, texts, percent, shingle)))
    free_shuffles(docs.sparkSession)

    labels = components(links).withColumnRenamed("node", "doc_id")
    cold = cut_lineage(cold.join(labels, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")))
    open_tokens = (cold.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y"))
                   .where("x <> y").select("token"))
    cold = cut_lineage(cold.join(open_tokens, "token", "left_semi"))
    other = cold.select(*[F.col(c).alias(c + "_b") for c in cold.columns])
    reach = F.least("pos", "pos_b") + F.least(F.col("n") - F.col("pos"), F.col("n_b") - F.col("pos_b"))
    near = ((F.col("token") == F.col("token_b")) & (F.col("doc_id") < F.col("doc_id_b")) & (F.col("component") != F.col("component_b"))
            & enough(F.least("n", "n_b")) & enough(reach))
    return links.unionAll(cut_lineage(verified(candidates(cold.join(other, near)), texts, percent, shingle)))


def near_components(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT,
                    shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id) per document; component_id is the smallest id reachable over links
    between documents with Jaccard similarity of at least ``percent`` / 100 over shingles of ``shingle`` words.

    A-Z is lower-cased. A text of fewer words than a shingle is one shingle; a null or empty text has none, links with
    nothing and is its own component. Rows of one id are one node. A row without id links with nothing and has no
    component. Other columns are not read."""
    spark = docs.sparkSession
    d = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    counts = spark.sparkContext.broadcast(document_counts(d.select("text"), shingle))
    sets = cut_lineage(d.mapInArrow(set_rows(counts, percent, shingle),
                                    "doc_id long, n long, h1 long, h2 long, matches int, prefix array<long>"))
    usable = sets.where("n > 0 AND doc_id IS NOT NULL")
    classes = cut_lineage(usable.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep")))
    reps = usable.join(classes.select("h1", "h2", "n", F.col("rep").alias("doc_id")), ["h1", "h2", "n", "doc_id"], "left_semi")
    labels = components(similar_edges(d, reps, percent, shingle))
    classes = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(
        F.col("h1").alias("c1"), F.col("h2").alias("c2"), F.col("n").alias("cn"), F.coalesce("component", "rep").alias("component"))
    out = sets.drop("prefix").join(classes, (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")) & (F.col("n") == F.col("cn"))
                                   & F.col("doc_id").isNotNull(), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, and rows without id, with all columns."""
    found = near_components(docs, key, text, percent, shingle).where("doc_id <> component_id").select(F.col("doc_id").alias("_later_id")).distinct()
    rows = docs.select(F.struct("*").alias("row"))
    return rows.join(found, F.col("row")[key] == F.col("_later_id"), "left_anti").select("row.*")
