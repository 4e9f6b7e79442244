"""Mixing sources to target weights with hash-threshold histograms; DataFrame functions only.

Every document has a 48-bit hash of its id. A source's budget is a number of whole passes over it and a rest; the
rest goes to the documents whose hash lies below a threshold. The threshold is found digit by digit: sizes are
summed by source and hash bucket, the bucket in which the running sum meets the budget is the boundary, and only
its documents are summed again by the next digit. Nothing is sorted but the few buckets of a source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorekit.session import cut_lineage

WEIGHTS = (5, 2, 1)
MAX_PASSES = 3
WORDS = r"[^\x20\x09-\x0D]+"
LEVELS, BITS = 4, 12             # 4096 buckets a source and level, 48 bits in all


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def unit_hash(key: Column, text: Column) -> Column:
    """48 bits of MD5 of the id; of the text where the id is null."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), text, F.lit(""))), 1, LEVELS * BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_passes: int = MAX_PASSES) -> DataFrame:
    """(source, source_size, target) of (source, source_size) rows, one a source.

    Sources in code point order (null last) have the weights in turn and share the total; none gets more than
    ``max_passes`` times its size, and what is over is shared by weight among the rest. Sources in order of
    cap / weight reach their cap first, so the first that stays below ends the search."""
    ranked = sizes.withColumn("nth", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") % len(weights) + 1).cast("int")).cast("long"))
    ranked = ranked.withColumn("cap", F.col("source_size") * max_passes)
    before = Window.orderBy(F.col("cap") / F.col("weight"), "nth").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    ranked = (ranked.withColumn("rest", F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
              .withColumn("rest_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
              .withColumn("free", F.col("rest") / F.col("rest_weight") <= F.col("cap") / F.col("weight")))
    first = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("weight"), F.col("nth"), "rest", "rest_weight"))).over(every)
    ranked = ranked.withColumn("level", first)
    share = F.col("weight") * F.col("level.rest") / F.col("level.rest_weight")
    capped = F.col("level").isNull() | (F.col("cap") < share)
    return ranked.select("source", "source_size", F.when(capped, F.col("cap").cast("double")).otherwise(share).alias("target"))


def mix_thresholds(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS,
                   max_passes: int = MAX_PASSES) -> DataFrame:
    """(source, source_size, target, passes, threshold, at_threshold) per source: a document is taken ``passes``
    times, and once more if its hash is below ``threshold`` (or equal, with ``at_threshold``)."""
    d = cut_lineage(docs.select(F.col(source).alias("source"), word_count(F.col(text)).alias("size"),
                                unit_hash(F.col(key), F.col(text)).alias("h")))
    plan = source_targets(d.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_passes)
    passes = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)).cast("long")
    plan = cut_lineage(plan.withColumn("passes", passes).withColumn("budget", F.col("target") - F.col("passes") * F.col("source_size"))
                       .withColumn("prefix", F.lit(0).cast("long")).withColumn("below", F.lit(0).cast("long")))
    for level in range(1, LEVELS + 1):
        bits = (LEVELS - level) * BITS
        edge = plan.select(F.col("source").alias("s"), "prefix", "below", "budget").where("budget > 0")
        inside = d.join(edge, F.col("source").eqNullSafe(F.col("s"))
                        & (F.shiftright("h", bits + BITS) == F.col("prefix")))
        sums = inside.groupBy("s", F.shiftright("h", bits).alias("bucket"), "below", "budget").agg(F.sum("size").alias("size"))
        run = sums.withColumn("upto", F.col("below") + F.sum("size").over(Window.partitionBy("s").orderBy("bucket")))
        found = run.where((F.col("upto") >= F.col("budget")) & (F.col("upto") - F.col("size") < F.col("budget")))
        found = found.select("s", "bucket", (F.col("upto") - F.col("size")).alias("new_below"), F.col("size").alias("at_size"))
        plan = cut_lineage(plan.drop("at_size").join(found, F.col("source").eqNullSafe(F.col("s")), "left")
                           .withColumn("prefix", F.col("bucket")).withColumn("below", F.col("new_below"))
                           .drop("s", "bucket", "new_below"))
    nearer = 2 * (F.col("budget") - F.col("below")) >= F.col("at_size")
    return cut_lineage(plan.select("source", "source_size", "target", "passes", F.coalesce("prefix", F.lit(0)).alias("threshold"),
                                   F.coalesce(nearer, F.lit(False)).alias("at_threshold")))


def _decided(docs: DataFrame, key: str, text: str, source: str, weights, max_passes: int) -> DataFrame:
    """(row, plan, copies): each document as a struct, its source's plan, and how often the mix takes it."""
    plan = mix_thresholds(docs, key, text, source, weights, max_passes).select(F.struct("*").alias("plan"))
    rows = docs.select(F.struct("*").alias("row"))
    h = unit_hash(F.col("row")[key], F.col("row")[text])
    more = (h < F.col("plan.threshold")) | ((h == F.col("plan.threshold")) & F.col("plan.at_threshold"))
    return (rows.join(plan, F.col("row")[source].eqNullSafe(F.col("plan.source")))
            .withColumn("copies", (F.col("plan.passes") + more.cast("long")).cast("int")))


def mix_report(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS,
               max_passes: int = MAX_PASSES) -> DataFrame:
    """(doc_id, size, source_size, target, taken) per document; taken counts repeats.

    Size is the number of words (none for a null or empty text). A null source is a source. Rows equal in id share
    their hash, so they are taken alike; reruns agree. Each source's words come within half of its boundary
    document (or group of equal hashes) of the target."""
    d = _decided(docs.select(key, text, source), key, text, source, weights, max_passes)
    size = word_count(F.col("row")[text])
    return d.select(F.col("row")[key].alias("doc_id"), size.alias("size"), "plan.source_size", "plan.target",
                    (size * F.col("copies")).alias("taken"))


def mix_sources(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS,
                max_passes: int = MAX_PASSES) -> DataFrame:
    """The mix: the rows of ``docs``, each as often as the mix takes it, with the columns of ``docs``."""
    d = _decided(docs, key, text, source, weights, max_passes).where("copies > 0")
    return d.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


ORACLE = r"""
WITH d AS (SELECT doc_id, source,
    CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, text, '')), 1, 12))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS nth FROM d GROUP BY source),
w AS (SELECT *, CASE nth % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS cap FROM s),
r AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS rw
    FROM w WINDOW b AS (ORDER BY cap / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT rest, rw FROM r WHERE rest / rw <= cap / weight ORDER BY cap / weight, nth LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN (SELECT count(*) FROM f) = 0 OR cap < weight * (SELECT rest FROM f) / (SELECT rw FROM f)
    THEN cap::DOUBLE ELSE (weight * (SELECT rest FROM f))::DOUBLE / (SELECT rw FROM f)::DOUBLE END AS target FROM r),
p AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size) END::BIGINT AS passes FROM t),
g AS (SELECT source, h, sum(size)::BIGINT AS gsize FROM d GROUP BY source, h),
c AS (SELECT source, h, gsize, sum(gsize) OVER (PARTITION BY source ORDER BY h) - gsize AS below FROM g),
e AS (SELECT c.source, c.h, (c.below + c.gsize <= p.target - p.passes * p.source_size)
    OR (c.below < p.target - p.passes * p.source_size AND 2 * (p.target - p.passes * p.source_size - c.below) >= c.gsize) AS more
    FROM c JOIN p ON c.source IS NOT DISTINCT FROM p.source)
SELECT d.doc_id, d.size, p.source_size, p.target, d.size * (p.passes + CASE WHEN e.more THEN 1 ELSE 0 END) AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source JOIN e ON e.source IS NOT DISTINCT FROM d.source AND e.h = d.h
"""
