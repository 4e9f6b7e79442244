"""Find the windows of W tokens that occur more than once in a corpus, exactly and without sending every window.

Every window has one anchor: the k-token gram with the smallest hash in it (the leftmost of equals). Equal
windows have equal anchors at the same place, and neighbouring windows mostly share theirs, so a document is
cut into *segments* (a run of windows with one anchor) of which only two hashes travel:

1. documents are dealt to chunks by a hash of their id and kept as a bucketed table (one shuffle of the texts);
2. every chunk sends each distinct (gram, segment) once; owners of a gram say which segments occur in another
   chunk as a whole, and which grams have several segments (pre-aggregated, so a passage in a third of all
   documents costs one entry a chunk);
3. the tokens of those few segments that share a gram but differ go to a *resolver* (a suffix automaton, or a
   column-wise BWT), the first copy of each only. A passage between words of its own in each document gives a kind a
   document at its edges, so a gram of many kinds is cut into blocks by the segments' hash; each pair of blocks is a
   group of its own, resolved in a task of its own, and what the pairs find is joined;
4. windows found come back to the chunks as intervals.

Chunks join their answers by bucket, so the texts are not shuffled again. A gram or segment is compared by 64
bits of hash each; tokens by their bytes or by 64 bits a word.

Rows with a null id come first, rows with one id follow each other in the order of their texts; a null text is
empty. Only the key and the text are read, so other columns can have any name."""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekit.llm.textblocks import (BYTE_VALUES, MIX1, mix, prefix_hash, range_hash, sliding_argmin, text_blocks,
                                    word_hashes, word_spans)
from lorekit.session import cut_lineage, stage_path

CHUNK_BYTES, MAX_SMALL_CHUNKS, LARGE_CHUNK_BYTES = 16 << 20, 4096, 256 << 20
NO_ID = -(2**63)


def chunk_count(total_bytes: int) -> int:
    """Chunks of 16 MB, up to 4096 of them; beyond that they grow to 256 MB before their number does."""
    small = math.ceil(total_bytes / CHUNK_BYTES)
    return max(8, min(small, max(MAX_SMALL_CHUNKS, math.ceil(total_bytes / LARGE_CHUNK_BYTES))))


def chunk_table(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, int]:
    """(doc_id, text, chunk) as a table bucketed by chunk, under the shared checkpoint folder."""
    spark = docs.sparkSession
    d = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = chunk_count(d.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    d = d.withColumn("chunk", F.pmod(F.xxhash64(F.coalesce("doc_id", F.xxhash64("text"))), F.lit(n)).cast("int"))
    name = f"lorekit_chunks_{uuid.uuid4().hex}"
    path = stage_path(spark, "chunks")
    (d.repartition(n, "chunk").write.option("path", path).option("compression", "zstd")
     .bucketBy(n, "chunk").format("parquet").saveAsTable(name))
    return spark.table(name), n


def ordered(table: pa.Table) -> tuple[np.ndarray, pa.Array]:
    """(order keys, texts) of a chunk's rows by id and text."""
    ids = table["doc_id"].to_numpy() if not table["doc_id"].null_count else table["doc_id"].fill_null(NO_ID).to_numpy()
    if len(np.unique(ids)) < len(ids):
        texts = table["text"].to_pylist()
        order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], texts[i])), np.int64)
    else:
        order = np.argsort(ids)
    return ids[order], table["text"].combine_chunks().take(pa.array(order))


def block_segments(values: np.ndarray, offsets: np.ndarray, window: int, gram: int):
    """Segments of the rows of one block; positions count from the block's start.

    (gram hash, segment hash, row, first window, last window, anchor) arrays, and the token hashes' prefix sums."""
    prefix = prefix_hash(values)
    n = len(values)
    if n < window:
        return None
    at = np.arange(n - gram + 1)
    grams = range_hash(prefix, at, at + gram)
    anchor = sliding_argmin(grams, window - gram + 1)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:len(anchor)]
    whole = at[:len(anchor)] + window <= offsets[1:][row]
    start = whole.copy()
    start[1:] &= (anchor[1:] != anchor[:-1]) | ~whole[:-1] | (row[1:] != row[:-1])
    stop = whole.copy()
    stop[:-1] &= start[1:] | ~whole[1:]
    first, last = np.flatnonzero(start), np.flatnonzero(stop)
    if not len(first):
        return None
    a = anchor[first]
    seg = mix(range_hash(prefix, first, last + window) + (a - first).astype(np.uint64) * MIX1)
    return grams[a], seg, row[first], first, last, a


def tokens(unit: str, offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes, token offsets of the rows) of a block."""
    if unit == "byte":
        return BYTE_VALUES[raw], offsets
    start, end, words_before = word_spans(offsets, raw)
    return word_hashes(raw, start, end), words_before


def chunk_segments(texts: pa.Array, unit: str, window: int, gram: int, keep_tokens: bool = False):
    """All segments of a chunk, sorted by (gram, segment, row, position): arrays gram, seg, row, first, last,
    anchor (positions within the row), and the tokens of each block where they are wanted."""
    parts, blocks = [], []
    for lo, offsets, raw in text_blocks(texts):
        values, off = tokens(unit, offsets, raw)
        found = block_segments(values, off, window, gram)
        if found is not None:
            g, s, row, first, last, a = found
            parts.append((g, s, row + lo, first - off[row], last - off[row], a - off[row]))
        if keep_tokens:
            blocks.append((lo, off, values if unit == "word" else raw))
    if not parts:
        return [np.zeros(0, t) for t in (np.uint64, np.uint64, *[np.int64] * 4)], blocks
    cols = [np.concatenate(c) for c in zip(*parts)]
    order = np.lexsort((cols[3], cols[2], cols[1], cols[0]))
    return [c[order] for c in cols], blocks


def distinct_entries(g: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Index of the first of each (gram, segment) in sorted arrays."""
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (s[1:] != s[:-1])
    return np.flatnonzero(new)


def entry_rows(unit: str, window: int, gram: int, buckets: int):
    schema = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("gram", pa.binary()), ("seg", pa.binary()),
                        ("doc", pa.binary())])

    def f(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids, texts = ordered(table)
        (g, s, row, *_), _ = chunk_segments(texts, unit, window, gram)
        e = distinct_entries(g, s)
        g, s, doc = g[e], s[e], ids[row[e]]
        b = (g % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(b, kind="stable")
        cut = np.searchsorted(b[order], np.arange(buckets + 1))
        rows = [(i, key[0].as_py(), g[o].tobytes(), s[o].tobytes(), doc[o].tobytes())
                for i in range(buckets) if len(o := order[cut[i]:cut[i + 1]])]
        return pa.table([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)] if rows else
                        [pa.array([], t.type) for t in schema], schema)
    return f


ELSEWHERE, SHIP, BLOCK_BITS = 1, 2, 2
SHARD_KINDS = {"word": 8192, "byte": 2048}    # kinds of a gram in a block, on average at most


def owner_rows(earlier: bool, shard_kinds: int):
    """Flags for the entries of a bucket: ELSEWHERE, the segment also occurs in another chunk (with ``earlier``: in
    an earlier document); SHIP, it is the first of its kind and its gram has several kinds; from bit ``BLOCK_BITS``
    on, the binary logarithm of the number of blocks the gram is cut into."""
    schema = pa.schema([("chunk", pa.int32()), ("bucket", pa.int32()), ("flags", pa.binary())])

    def f(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        read = lambda name, t: [np.frombuffer(x.as_buffer(), t) for x in table[name]]
        gram, seg, doc = read("gram", np.uint64), read("seg", np.uint64), read("doc", np.int64)
        lens = [len(x) for x in gram]
        chunk = np.repeat(table["chunk"].to_numpy(), lens)
        gram, seg, doc = np.concatenate(gram), np.concatenate(seg), np.concatenate(doc)
        o = np.lexsort((chunk, doc, seg, gram))
        g, s = gram[o], seg[o]
        first = distinct_entries(g, s)
        kind = np.zeros(len(g), np.int64)
        kind[first[1:]] = 1
        kind = np.cumsum(kind)
        is_first = np.zeros(len(g), bool)
        is_first[first] = True
        again = np.bincount(kind) > 1
        gram_no = np.cumsum(np.append(0, g[1:] != g[:-1]))
        kinds = np.bincount(gram_no[first])
        bits = np.ceil(np.log2(np.maximum(kinds / shard_kinds, 1))).astype(np.int64)
        ship = is_first & (kinds[gram_no] > 1)
        flags = np.zeros(len(g), np.uint8)
        flags[o] = ELSEWHERE * (~is_first if earlier else again[kind]) + ship * (SHIP + (bits[gram_no] << BLOCK_BITS))
        cut = np.cumsum([0, *lens])
        out = [flags[cut[i]:cut[i + 1]] for i in range(len(lens))]
        keep = [i for i, x in enumerate(out) if x.any()]
        return pa.table([table["chunk"].combine_chunks().take(pa.array(keep, pa.int64())),
                         pa.array([key[0].as_py()] * len(keep), pa.int32()),
                         pa.array([out[i].tobytes() for i in keep], pa.binary())], schema)
    return f


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) index of each run of neighbouring integers in a sorted array."""
    if not len(values):
        return values, values
    gap = np.flatnonzero(np.diff(values) != 1)
    return values[np.append(0, gap + 1)], values[np.append(gap, len(values) - 1)]


#: What goes back to a chunk (bucket -1) or on to a resolver (bucket of the gram): rows, windows from first to
#: last, the anchor relative to first, the gram, and the tokens. A gram cut into blocks has rows (shard, block) of its
#: own; shard is its hash.
PIECES = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("row", pa.binary()), ("first", pa.binary()),
                    ("last", pa.binary()), ("anchor", pa.binary()), ("gram", pa.binary()), ("doc", pa.binary()),
                    ("tokens", pa.binary()), ("shard", pa.int64()), ("block", pa.int32()), ("blocks", pa.int32())])
PIECES_DDL = ("bucket int, chunk int, row binary, first binary, last binary, anchor binary, gram binary, doc binary, "
              "tokens binary, shard long, block int, blocks int")
SHIP_BYTES = 4 << 20


def piece_rows(unit: str, window: int, gram: int, buckets: int, earlier: bool):
    """Whole segments that repeat, as intervals (bucket -1), and the segments to ship, by bucket."""
    def f(key: tuple[pa.Scalar, ...], table: pa.Table, flags: pa.Table) -> pa.Table:
        chunk = key[0].as_py()
        if not table.num_rows:
            return PIECES.empty_table()
        ids, texts = ordered(table)
        (g, s, row, first, last, anchor), blocks = chunk_segments(texts, unit, window, gram, keep_tokens=True)
        if not len(g):
            return PIECES.empty_table()
        e = distinct_entries(g, s)
        count = np.diff(np.append(e, len(g)))
        b = (g[e] % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(b, kind="stable")
        cut = np.searchsorted(b[order], np.arange(buckets + 1))
        flag = np.zeros(len(e), np.uint8)
        for i, x in zip(flags["bucket"].to_pylist(), flags["flags"]):
            flag[order[cut[i]:cut[i + 1]]] = np.frombuffer(x.as_buffer(), np.uint8)
        entry = np.repeat(np.arange(len(e)), count)
        again = (flag[entry] & ELSEWHERE) > 0
        if earlier:
            later = np.ones(len(g), bool)
            later[e] = False
            again |= later
        else:
            again |= count[entry] > 1
        out = [(-1, chunk, row[again].astype(np.int32).tobytes(), first[again].tobytes(), last[again].tobytes(),
                b"", b"", b"", b"", 0, 0, 1)] if again.any() else []
        ship = np.flatnonzero(flag & SHIP)
        if len(ship):
            blocks_of = np.int64(1) << (flag >> BLOCK_BITS).astype(np.int64)
            shard = np.where(blocks_of > 1, g[e].view(np.int64), 0)
            part = (mix(s[e]) % blocks_of.astype(np.uint64)).astype(np.int64)
            ship = ship[np.lexsort((part[ship], shard[ship], b[ship]))]
            shard, part, blocks_of = shard[ship], part[ship], blocks_of[ship]
            starts = np.array([x[0] for x in blocks])
            at, size, bucket = e[ship], last[e[ship]] - first[e[ship]] + window, b[ship]
            block = np.searchsorted(starts, row[at], side="right") - 1
            texts_of = [blocks[k][2][p:p + m] for k, p, m in zip(
                block, first[at] + np.array([blocks[k][1][r - starts[k]] for k, r in zip(block, row[at])], np.int64), size)]
            width = 8 if unit == "word" else 1
            lot = np.cumsum(np.append(0, (bucket[1:] != bucket[:-1]) | (shard[1:] != shard[:-1]) | (part[1:] != part[:-1])))
            lot = lot * (1 << 32) + np.cumsum(size * width) // SHIP_BYTES
            edge = np.append(np.flatnonzero(np.append(True, lot[1:] != lot[:-1])), len(at))
            for lo, hi in zip(edge[:-1], edge[1:]):
                x = at[lo:hi]
                out.append((int(bucket[lo]), chunk, row[x].astype(np.int32).tobytes(), first[x].tobytes(),
                            last[x].tobytes(), (anchor[x] - first[x]).astype(np.int32).tobytes(), g[x].tobytes(),
                            ids[row[x]].tobytes(), np.concatenate(texts_of[lo:hi]).tobytes(), int(shard[lo]), int(part[lo]), int(blocks_of[lo])))
        if not out:
            return PIECES.empty_table()
        return pa.table([pa.array(c, t.type) for c, t in zip(zip(*out), PIECES)], PIECES)
    return f


def resolver_rows(resolve, unit: str, window: int):
    """Intervals found by ``resolve(groups, window)``; a group is the shipped segments of one gram in order of
    (document, position): a list of (anchor, tokens) with arrays of windows that repeat as the answer."""
    def f(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        dtype = np.uint64 if unit == "word" else np.uint8
        read = lambda name, t: [np.frombuffer(x.as_buffer(), t) for x in table[name]]
        row, first, last, anchor = read("row", np.int32), read("first", np.int64), read("last", np.int64), read("anchor", np.int32)
        lens = [len(x) for x in row]
        chunk = np.repeat(table["chunk"].to_numpy(), lens)
        row, first, last, anchor = (np.concatenate(x) for x in (row, first, last, anchor))
        gram, doc = np.concatenate(read("gram", np.uint64)), np.concatenate(read("doc", np.int64))
        toks = np.concatenate(read("tokens", dtype))
        cut = np.cumsum(np.append(0, last - first + window))
        order = np.lexsort((first + anchor, row, chunk, doc, gram))
        edge = np.append(np.flatnonzero(np.append(True, gram[order][1:] != gram[order][:-1])), len(order))
        groups = [order[a:b] for a, b in zip(edge[:-1], edge[1:])]
        found = resolve([[(int(anchor[i]), toks[cut[i]:cut[i + 1]]) for i in x] for x in groups], window)
        at, lo, hi = [], [], []
        for x, hits in zip(groups, found):
            for i, windows in zip(x, hits):
                a, z = runs(windows)
                at += [i] * len(a)
                lo += list(first[i] + a)
                hi += list(first[i] + z)
        if not at:
            return PIECES.empty_table()
        at, lo, hi = np.array(at), np.array(lo, np.int64), np.array(hi, np.int64)
        out = [(-1, int(c), row[at[m]].astype(np.int32).tobytes(), lo[m].tobytes(), hi[m].tobytes(), b"", b"", b"", b"", 0, 0, 1)
               for c in np.unique(chunk[at]) for m in [chunk[at] == c]]
        return pa.table([pa.array(c, t.type) for c, t in zip(zip(*out), PIECES)], PIECES)
    return f


def block_pairs(pieces: DataFrame) -> DataFrame:
    """The shipped pieces with their group (bucket, shard, pair): a block goes to its pair with each other block of
    its gram, so two segments of a gram meet in at least one group; a gram of one block has one group a bucket."""
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: (o != F.col("block")) | (F.col("blocks") == 1))
    rows = pieces.where("bucket >= 0").select("*", F.explode(others).alias("other"))
    return rows.withColumn("pair", F.least("block", "other").cast("long") * F.col("blocks") + F.greatest("block", "other"))


def repeated_windows(docs: DataFrame, key: str, text: str, unit: str, window: int, gram: int, earlier: bool, resolve,
                     finish, finish_schema: str) -> DataFrame:
    """``finish(ids, texts, marks)`` of every chunk, where marks has for each row (first, last) arrays of windows
    that repeat. With ``earlier`` a window counts if it also starts earlier, else if it also starts elsewhere."""
    chunks, n = chunk_table(docs, key, text)
    by_chunk = chunks.groupBy("chunk")
    entries = by_chunk.applyInArrow(entry_rows(unit, window, gram, n),
                                    "bucket int, chunk int, gram binary, seg binary, doc binary")
    flags = entries.groupBy("bucket").applyInArrow(owner_rows(earlier, SHARD_KINDS[unit]), "chunk int, bucket int, flags binary")
    pieces = cut_lineage(by_chunk.cogroup(flags.groupBy("chunk")).applyInArrow(
        piece_rows(unit, window, gram, n, earlier), PIECES_DDL))
    resolved = (block_pairs(pieces).groupBy("bucket", "shard", "pair")
                .applyInArrow(resolver_rows(resolve, unit, window), PIECES_DDL))
    marks = pieces.where("bucket < 0").unionAll(resolved).select("chunk", "row", "first", "last")

    def g(key: tuple[pa.Scalar, ...], table: pa.Table, found: pa.Table) -> pa.Table:
        ids, texts = ordered(table)
        read = lambda name, t: np.concatenate([np.zeros(0, t), *[np.frombuffer(x.as_buffer(), t) for x in found[name]]])
        row, first, last = read("row", np.int32), read("first", np.int64), read("last", np.int64)
        order = np.argsort(row, kind="stable")
        return finish([None if i == NO_ID else int(i) for i in ids], texts, np.searchsorted(row[order], np.arange(len(ids) + 1)),
                      first[order], last[order])
    return by_chunk.cogroup(marks.groupBy("chunk")).applyInArrow(g, finish_schema)


def covered(size: int, first: np.ndarray, last: np.ndarray, window: int) -> np.ndarray:
    """Tokens of a row that lie in one of the windows first..last."""
    step = np.zeros(size + 1, np.int32)
    np.add.at(step, first, 1)
    np.add.at(step, last + window, -1)
    return np.cumsum(step[:-1]) > 0
