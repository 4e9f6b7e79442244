"""Exact and near-duplicate detection.

Near duplicates: MinHash over word shingles (native array expressions) and LSH
band keys. Rows with one signature are one class. The classes of a small band are
all held against each other; they are linked if enough of their signatures agree.
In a large band all classes first meet some of its own: those that share bands with
the most rows, and some taken by hash. Where several components are left, the rows
outside the band's largest meet all its rows, in pairs of blocks in memory, so a
band shared by a third of all rows never becomes its pairs. Blocks are compared by
codes of a byte, and rows that have too few values in common with the whole other
block are left out. Groups are the connected components of the links."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekit.functions.text import sha_hex
from lorekit.operators.components import components
from lorekit.session import cut_lineage

PRIME = 2147483647          # 2^31 - 1
NUM_BANDS, ROWS_PER_BAND = 16, 4
SHINGLE = 3
MIN_AGREEMENT = 0.6         # share of equal signature values, an estimate of the Jaccard similarity
BLOCK, BLOCK_CODE, LOT_ROWS = 16384, 1 << 20, 16384
PIVOTS = 256                # rows of a large band, of each of two kinds, that all its rows meet first


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Groups of identical text (16-hex SHA-256): (sha16, n, first)."""
    g = docs.groupBy(sha_hex(text, 16).alias("sha16")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first"))
    return g.where(F.col("n") >= 2)


def coefficients(n: int = NUM_BANDS * ROWS_PER_BAND, seed: int = 7) -> list[tuple[int, int]]:
    """(a, b) of the hash functions h -> (a h + b) mod PRIME of a signature."""
    rnd = random.Random(seed)
    return [(rnd.randrange(1, PRIME), rnd.randrange(0, PRIME)) for _ in range(n)]


def minhash_signatures(docs: DataFrame, key: str, text: str, size: int = NUM_BANDS * ROWS_PER_BAND,
                       shingle: int = SHINGLE, seed: int = 7, md5_hash: bool = False) -> DataFrame:
    """(k, sig): MinHash signature of the lower-cased word ``shingle``-grams (whole
    text; texts shorter than a shingle use their whole word list). With ``md5_hash``
    shingles are hashed by the first 32 bits of their MD5, which other engines
    compute too; else by xxhash64, which is faster.

    Shingle hashes are exploded to rows and the signature is ``size`` ``min``
    aggregates: codegen'd arithmetic with partial aggregation, and a document's
    rows stay in its partition (explode does not shuffle)."""
    words = F.filter(F.split(F.lower(F.col(text)), r"\s+"), lambda x: x != "")
    d = docs.select(F.col(key).alias("k"), words.alias("w")).where(F.size("w") > 0)
    n = F.greatest(F.size("w") - shingle + 1, F.lit(1))
    sh = d.select("k", F.explode(F.sequence(F.lit(1), n)).alias("i"), "w")
    gram = F.concat_ws(" ", F.slice("w", F.col("i"), shingle))
    h = F.conv(F.substring(F.md5(gram), 1, 8), 16, 10).cast("long") if md5_hash else F.xxhash64(gram)
    sh = sh.select("k", F.pmod(h, F.lit(PRIME)).alias("h"))
    sig = sh.groupBy("k").agg(*[F.min(F.pmod(F.col("h") * a + b, F.lit(PRIME))).alias(f"m{j}")
                                for j, (a, b) in enumerate(coefficients(size, seed))])
    return sig.select("k", F.array(*[f"m{j}" for j in range(size)]).alias("sig"))


def _block_links(least: float, block_code: int):
    """(a, b) of the rows (k, band, other, block, sig) of a lot: a spanning set of the links within each (band,
    pair of blocks). Everything it uses is in the closure, so executors need no copy of this module."""
    few, tile, wide, least = 16, 64, 4096, int(np.ceil(least))

    def coded(left, right, alone):
        """Codes of two blocks (a row a column of the signature), equal where the values are, and how many values of
        each row the other block has; a value that only one of the blocks has is never equal to another."""
        found = []
        for x, y in zip(left, right):
            kinds, at, times = np.unique(x, return_inverse=True, return_counts=True)
            if alone:
                there, hit, used = at, times[at] > 1, times > 1
            else:
                there = np.minimum(np.searchsorted(kinds, y), len(kinds) - 1)
                hit, used = kinds[there] == y, np.zeros(len(kinds), bool)
                used[there[hit]] = True
            number = np.cumsum(used) - 1
            found.append((number[at], used[at], number[there], hit, used.sum()))
        kind = np.min_scalar_type(max(n for *_, n in found) + 1)
        one, two = np.iinfo(kind).max - 1, np.iinfo(kind).max
        codes = [np.stack([np.where(hit, n, miss).astype(kind) for n, hit in ((r[i], r[i + 1]) for r in found)]) for i, miss in ((0, one), (2, two))]
        return codes[0], sum(r[1].astype(np.int32) for r in found), codes[1], sum(r[3].astype(np.int32) for r in found)

    def f(table: pa.Table) -> pa.Table:
        order = np.lexsort([table[c].to_numpy() for c in ("block", "other", "band")])
        band, other, block = (table[c].to_numpy()[order] for c in ("band", "other", "block"))
        sig = table["sig"].combine_chunks().flatten().to_numpy().reshape(len(order), -1)[order]
        edge = np.flatnonzero(np.append(True, (band[1:] != band[:-1]) | (other[1:] != other[:-1])))
        sizes = np.diff(np.append(edge, len(order)))
        root = np.arange(len(order))

        def link(up, i, j):
            while len(i):
                top, low = np.maximum(up[i], up[j]), np.minimum(up[i], up[j])
                apart = top != low
                i, j = i[apart], j[apart]
                np.minimum.at(up, top[apart], low[apart])
                while (up[up] != up).any():
                    up[:] = up[up]

        # groups of a few rows, all at once: each row against the next, the one after it, ...
        group, size = np.repeat(np.arange(len(edge)), sizes), np.repeat(sizes, sizes)
        x, y = np.divmod(other, block_code)
        for d in range(1, few):
            i = np.flatnonzero((size[:-d] <= few) & (group[:-d] == group[d:]))
            i = i[(block[i] == x[i]) & (block[i + d] == y[i])]
            i = i[(sig[i] == sig[i + d]).sum(axis=1) >= least]
            link(root, i, i + d)

        for lo, hi in zip(edge[sizes > few], (edge + sizes)[sizes > few]):
            mid, alone = lo + np.searchsorted(block[lo:hi], x[lo], side="right"), x[lo] == y[lo]
            if not alone and mid in (lo, hi):
                continue
            one, two = (sig[lo:hi], sig[lo:hi]) if alone else (sig[lo:mid], sig[mid:hi])
            left, n_left, right, n_right = coded(one.T, two.T, alone)
            # a row needs as many values in common with the whole other block as with a row of it
            i_left, i_right = np.flatnonzero(n_left >= least), np.flatnonzero(n_right >= least)
            left, right = left[:, i_left, None], np.ascontiguousarray(right[:, i_right])
            i_right, up = i_right + (0 if alone else mid - lo), np.arange(hi - lo)
            for r in range(0, len(i_left), tile):
                for c in range(r - r % wide if alone else 0, len(i_right), wide):
                    equal = np.empty((min(tile, len(i_left) - r), min(wide, len(i_right) - c)), bool)
                    same = np.zeros(equal.shape, np.min_scalar_type(len(left)))
                    for p, q in zip(left, right):
                        np.equal(p[r:r + tile], q[None, c:c + wide], out=equal)
                        np.add(same, equal.view(np.uint8), out=same)
                    near = same >= least
                    mine, its = i_left[r:r + tile], i_right[c:c + wide]
                    some = np.flatnonzero(near.any(axis=0))
                    if len(some):
                        link(up, mine[near[:, some].argmax(axis=0)], its[some])
                        i, j = np.nonzero(near & (up[mine][:, None] != up[its]))
                        link(up, mine[i], its[j])
            root[lo:hi] = lo + up
        hit = np.flatnonzero(root != np.arange(len(root)))
        keys = table["k"].combine_chunks()
        return pa.table({"a": keys.take(pa.array(order[root[hit]])), "b": keys.take(pa.array(order[hit]))})
    return f


def near_links(signatures: DataFrame, bands: int = NUM_BANDS, rows: int = ROWS_PER_BAND,
               min_agreement: float = MIN_AGREEMENT) -> DataFrame:
    """(a, b): links that connect what pairs of one band with at least ``min_agreement`` of their signatures in
    agreement connect; links within a component that is known already are left out. Bands of one row give nothing."""
    sigs = cut_lineage(signatures)
    least = min_agreement * bands * rows
    classes = cut_lineage(sigs.groupBy("sig").agg(F.min("k").alias("k")))
    equal = sigs.join(classes.withColumnRenamed("k", "a"), "sig").where("k <> a").select("a", F.col("k").alias("b"))
    keys = F.array(*[F.xxhash64(F.lit(b), F.slice("sig", b * rows + 1, rows)) for b in range(bands)])
    edges = classes.select("k", F.explode(keys).alias("band"))
    edges = cut_lineage(edges.join(edges.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "band"))
    large = edges.where(F.col("n") > 4 * PIVOTS)

    def apart(known):
        """Rows (k, band, n, component, main) of the large bands that hold several components; main is the largest."""
        rest = large.join(components(known).withColumnRenamed("node", "k"), "k", "left").withColumn("component", F.coalesce("component", "k"))
        rest = cut_lineage(rest.select("k", "band", "n", "component"))
        shares = rest.groupBy("band", "component").agg(F.count(F.lit(1)).alias("share"))
        bands = shares.groupBy("band").agg(F.max(F.struct("share", "component")).alias("main"), F.count(F.lit(1)).alias("parts"))
        return rest.join(bands.where("parts > 1").drop("parts"), "band")

    def compared(m, last_other):
        """Links of rows (k, band, block) with the blocks 0 .. ``last_other`` of their bands."""
        pair = lambda o: F.least("block", o) * F.lit(BLOCK_CODE) + F.greatest("block", o)
        m = cut_lineage(m.select("k", "band", "block", F.explode(F.transform(F.sequence(F.lit(0), last_other), pair)).alias("other")))
        lots = max(1, -(-m.count() // LOT_ROWS))
        m = m.join(classes, "k").withColumn("lot", F.pmod(F.xxhash64("band", "other"), F.lit(lots)))
        kind = classes.schema["k"].dataType.simpleString()
        return cut_lineage(m.groupBy("lot").applyInArrow(_block_links(least, BLOCK_CODE), f"a {kind}, b {kind}"))

    blocks = lambda n, size: F.ceil(n / size).cast("int")
    number = lambda n: F.pmod(F.xxhash64("k"), n)
    # small bands are compared whole. In a large one all rows meet its hubs, the PIVOTS rows that share bands with the
    # most rows, and about PIVOTS rows taken by hash: as many comparisons as the band has rows
    met = large.groupBy("k").agg(F.sum("n").alias("met"))
    place = F.row_number().over(Window.partitionBy("band").orderBy(F.desc("met"), "k"))
    hubs = large.join(met, "k").withColumn("place", place).where(F.col("place") <= PIVOTS).select("k", "band", F.lit(True).alias("hub"))
    m = edges.join(hubs, ["k", "band"], "left").withColumn("mains", F.when(F.col("n") > 4 * PIVOTS, blocks(F.col("n"), BLOCK)).otherwise(0))
    pivot = (F.col("mains") == 0) | F.col("hub").isNotNull() | (number(blocks(F.col("n"), PIVOTS)) == 0)
    m = m.withColumn("block", F.when(pivot, 0).otherwise(1 + F.pmod(F.xxhash64("k", F.lit(1)), F.col("mains"))))
    links = cut_lineage(equal).unionAll(compared(m, F.when(F.col("block") == 0, F.col("mains")).otherwise(0)))
    if large.isEmpty():
        return links

    # a link still missing has an end outside its band's largest component: those rows meet each other and the rest,
    # the rest not itself
    n_main = F.col("main.share")
    m = apart(links).select("k", "band", (F.col("component") != F.col("main.component")).alias("odd"),
                            blocks(F.col("n") - n_main, BLOCK).alias("odds"), blocks(n_main, BLOCK).alias("mains"))
    m = m.withColumn("block", F.when(F.col("odd"), number(F.col("odds"))).otherwise(F.col("odds") + number(F.col("mains"))))
    return links.unionAll(compared(m, F.col("odds") + F.when(F.col("odd"), F.col("mains")).otherwise(0) - 1))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """(key, cluster, size) for rows in a near-duplicate cluster of two or more."""
    sigs = minhash_signatures(docs, key, text, **kw).withColumn("sig", F.col("sig").cast("array<int>"))      # all below PRIME
    comp = cut_lineage(components(near_links(sigs)))
    sizes = comp.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return comp.join(sizes, "component").select(F.col("node").alias(key), F.col("component").alias("cluster"), "size")
