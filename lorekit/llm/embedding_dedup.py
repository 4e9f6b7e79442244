"""Embedding near-dedup with p-stable hashing for Euclidean distance.

Vectors are normalised, so a cosine bound is a distance bound. A table's bucket is the vector of ``PROJECTIONS``
random (Gaussian, hence 2-stable) projections, shifted and cut into cells of ``CELL``. Equal vectors are one class
first. Classes of one label that share a bucket of one of ``TABLES`` tables are compared exactly; a pair counts in
the first table where it meets. With these parameters a pair at cosine 0.93 meets with probability 0.97 and closer
pairs more often (see the test for the recall measured)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekit.operators.components import components
from lorekit.session import cut_lineage

COSINE = 0.93
TABLES, PROJECTIONS, CELL, SEED = 12, 6, 1.5, 20240917
BLOCK = 2048                     # classes of a bucket compared with each other at once
LOT_BYTES = 24 << 20             # of the rows of many buckets in one Python call


def projections(dim: int, tables: int = TABLES, width: int = PROJECTIONS) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.standard_normal((dim, tables * width)), rng.uniform(0, CELL, tables * width)


def bucket_keys(unit: np.ndarray, tables: int = TABLES) -> np.ndarray:
    """One int64 bucket key per row and table."""
    a, shift = projections(unit.shape[1], tables)
    cells = np.floor((unit @ a + shift) / CELL).astype(np.int64).reshape(len(unit), tables, -1)
    odd = (np.arange(1, cells.shape[2] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    h = (cells.astype(np.uint64) * odd).sum(axis=2, dtype=np.uint64) + np.arange(tables, dtype=np.uint64)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(29))).view(np.int64)


def matrix(column, dtype=np.float64) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(flat), -1)


def normal(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def class_buckets(batches):
    """(class_id, label, n, v, table, bucket) for every class and table."""
    for batch in batches:
        dims = np.diff(batch.column("v").offsets.to_numpy()) if batch.num_rows else np.zeros(0)
        for d in np.unique(dims):
            part = batch.filter(pa.array(dims == d))
            keys = bucket_keys(normal(matrix(part.column("v"))))
            n = part.num_rows
            take = pa.array(np.repeat(np.arange(n), TABLES))
            out = [part.column(c).take(take) for c in ("class_id", "label", "n", "v")]
            yield pa.RecordBatch.from_arrays([*out, pa.array(np.tile(np.arange(TABLES, dtype=np.int32), n)), pa.array(keys.ravel())],
                                             ["class_id", "label", "n", "v", "tab", "bucket"])


def spanning(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Smallest index reachable from each of n nodes over links i-j."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def linked_in_bucket(ids, weight, unit, keys, tab, one, two, cosine):
    """(sum of linked copies per row, root row per row) from pairs of rows of one bucket: all pairs if the blocks
    are the same, else the pairs between them."""
    x = np.arange(len(ids))
    if one is two:
        i, j = np.nonzero(np.triu(unit @ unit.T >= cosine, 1))
    else:
        a, b = x[one], x[two]
        i, j = np.nonzero(unit[a] @ unit[b].T >= cosine)
        i, j = a[i], b[j]
    if not len(i):
        return None
    earlier = (keys[i, :tab] == keys[j, :tab]).any(axis=1) if tab else np.zeros(len(i), bool)
    count = np.zeros(len(ids), np.int64)
    np.add.at(count, i[~earlier], weight[j[~earlier]])
    np.add.at(count, j[~earlier], weight[i[~earlier]])
    return count, spanning(i, j, len(ids))


def pair_lots(cosine: float):
    schema = pa.schema([("class_id", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def f(table: pa.Table) -> pa.Table:
        ids, weight = table["class_id"].to_numpy(), table["n"].to_numpy()
        key = table["bucket_no"].to_numpy()
        tab, block, other = (table[c].to_numpy() for c in ("tab", "block", "other"))
        lens = np.diff(table["v"].combine_chunks().offsets.to_numpy())
        order = np.lexsort((ids, block, other, tab, key, lens))
        same = [x[order] for x in (lens, key, tab, other)]
        edge = np.flatnonzero(np.append(True, np.any([x[1:] != x[:-1] for x in same], axis=0)))
        out = []
        for lo, hi in zip(edge, np.append(edge[1:], len(order))):
            if hi - lo < 2:
                continue
            rows = order[lo:hi]
            unit = normal(matrix(table["v"].take(pa.array(rows))))
            a, b = divmod(other[rows[0]], 1 << 20)
            one, two = block[rows] == a, block[rows] == b
            found = linked_in_bucket(ids[rows], weight[rows], unit, bucket_keys(unit), int(tab[rows[0]]), one,
                                     one if a == b else two, cosine)
            if found:
                count, root = found
                hit = np.flatnonzero((count > 0) | (root != np.arange(len(rows))))
                out.append((ids[rows][hit], count[hit], ids[rows][root[hit]]))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table([pa.array(c, pa.int64()) for c in cols], schema)
    return f


def embedding_links(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
                    cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row.

    Rows are compared within a label. A null label, or a vector that is null, empty, zero, or holds a null or
    non-finite component, links with nothing; n_links is then 0 and the component is the row itself. Vectors of
    different length are not compared. A row without id links with nothing and has no component; rows of one id
    and one vector count each. Other columns are not read."""
    v = F.col(vector).cast("array<double>")
    good = (F.col(key).isNotNull() & F.col(label).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
            & F.exists(v, lambda x: x != 0))
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.when(good, F.col(label)).alias("label"),
                          F.when(good, v).alias("v"))
    rows = rows.withColumn("c1", F.when(F.col("v").isNotNull(), F.xxhash64("label", "v"))).withColumn("c2", F.xxhash64("v", "label"))
    classes = (rows.where("c1 IS NOT NULL").groupBy("c1", "c2")
               .agg(F.min("vec_id").alias("class_id"), F.count(F.lit(1)).alias("n"), F.first("label").alias("label"), F.first("v").alias("v")))
    classes = cut_lineage(classes)

    placed = classes.select("class_id", "n", F.xxhash64("label").alias("label"), "v").mapInArrow(
        class_buckets, "class_id long, label long, n long, v array<double>, tab int, bucket long")
    placed = placed.withColumn("bucket_no", F.xxhash64("label", "bucket", "tab")).drop("label", "bucket")
    sizes = placed.groupBy("bucket_no").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    placed = placed.join(sizes, "bucket_no").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    own = F.pmod(F.xxhash64("class_id"), F.col("blocks"))
    wide = F.lit(1 << 20)
    placed = placed.withColumn("block", own).select(
        "class_id", "n", "v", "tab", "bucket_no", "block",
        F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1),
                              lambda o: F.least("block", o) * wide + F.greatest("block", o))).alias("other"))
    blocks = F.ceil(F.col("size") / BLOCK)                              # a row goes to each block of its bucket
    sent = sizes.agg(F.sum(F.col("size") * blocks)).first()[0] or 0
    width = classes.agg(F.max(F.size("v"))).first()[0] or 0
    lots = max(8, -(-sent * (8 * width + 64) // LOT_BYTES))
    placed = placed.withColumn("lot", F.pmod(F.xxhash64("bucket_no", "other"), F.lit(lots)))
    found = cut_lineage(placed.groupBy("lot").applyInArrow(lambda table: pair_lots(cosine)(table.drop_columns(["lot"])),
                                                            "class_id long, links long, root long"))
    links = found.groupBy("class_id").agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("class_id").alias("a"), F.col("root").alias("b")))
    result = (classes.select("c1", "c2", "class_id", "n").join(links, "class_id", "left")
              .join(comp.withColumnRenamed("node", "class_id"), "class_id", "left")
              .select(F.col("c1").alias("d1"), F.col("c2").alias("d2"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                      F.coalesce("component", "class_id").alias("component")))
    out = rows.select("vec_id", "c1", "c2").join(result, (F.col("c1") == F.col("d1")) & (F.col("c2") == F.col("d2")), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      (F.col("vec_id").isNull() | (F.col("vec_id") == component)).alias("kept"))
