"""Line dedup by distinct-site spread: HyperLogLog sketches per line, merged by aggregation.

A line (by 64 bits of hash; lines without a word do not count) that stands on at least ``min_sites`` sites is
boilerplate. It stays in one document, its home, and goes from all others, whatever share of them it is. A sketch is kept
as rows (line, register, largest rank), so raw lines merge by a max aggregate with map-side combining, and a line on
every site costs its registers at most. Only lines whose estimate is within ``BAND`` of the threshold get an exact
distinct count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekit.session import cut_lineage

MIN_SITES = 10
REGISTER_BITS = 12               # a register is a row only where it is used
BAND = 0.35                      # above twenty standard errors of 4,096 registers


def _hash(line: Column) -> Column:
    return F.xxhash64(line)


def _has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def spread_estimates(sites: DataFrame) -> DataFrame:
    """(line, spread) from (line, site) rows, repeats and all; site is a 64-bit hash."""
    m = 1 << REGISTER_BITS
    rest = F.shiftrightunsigned("site", REGISTER_BITS)
    rank = F.bit_count(rest.bitwiseAND(-rest) - 1) + 1      # of the lowest set bit
    registers = sites.select("line", F.col("site").bitwiseAND(m - 1).alias("register"), rank.alias("rank"))
    registers = registers.groupBy("line", "register").agg(F.max("rank").alias("rank"))
    sums = registers.groupBy("line").agg(F.sum(F.pow(F.lit(2.0), -F.col("rank"))).alias("s"), F.count(F.lit(1)).alias("used"))
    raw = 0.7213 / (1 + 1.079 / m) * m * m / (F.col("s") + (m - F.col("used")))
    few = m * F.log(m / (m - F.col("used")))
    return sums.select("line", F.when((raw <= 2.5 * m) & (F.col("used") < m), few).otherwise(raw).alias("spread"))


def boilerplate_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """(line, home): hashes of the lines that stand on at least ``min_sites`` sites, and the smallest id of a document
    that holds each (null where none has an id). A null site is none."""
    lines = docs.select(F.col(key).alias("k"), F.xxhash64(F.col(site)).alias("site"), F.col(site).isNull().alias("nowhere"),
                        F.explode(F.split(F.col(text), "\n")).alias("l")).where(_has_word(F.col("l")))
    lines = lines.select("k", F.when(~F.col("nowhere"), F.col("site")).alias("site"), _hash(F.col("l")).alias("line"))
    spread = spread_estimates(lines.where("site IS NOT NULL")).where(F.col("spread") >= min_sites * (1 - BAND))
    likely = cut_lineage(spread.select("line", (F.col("spread") <= min_sites * (1 + BAND)).alias("near")))
    # one scan for the exact counts of the near ones and the homes of all
    found = lines.join(likely, "line").select("line", "near", F.when(F.col("near"), F.col("site")).alias("site"), "k")
    found = found.groupBy("line", "near", "site").agg(F.min("k").alias("k")).groupBy("line", "near").agg(F.count("site").alias("n"), F.min("k").alias("home"))
    return cut_lineage(found.where(~F.col("near") | (F.col("n") >= min_sites)).select("line", "home"))


def _marked(docs: DataFrame, key: str, text: str, site: str, min_sites: int) -> DataFrame:
    """(row, n_lines, n_removed, kept) with each document as a struct."""
    bad = boilerplate_lines(docs, key, text, site, min_sites)
    ident = [F.col(key).alias("k"), F.xxhash64(F.col(text)).alias("th")]      # rows equal in both have equal results
    lines = docs.select(*ident, F.explode(F.split(F.col(text), "\n")).alias("l")).select("k", "th", _hash(F.col("l")).alias("line"))
    hits = lines.join(bad, "line").where(~F.col("k").eqNullSafe(F.col("home"))).groupBy("k", "th").agg(F.collect_set("line").alias("bad"))
    rows = docs.select(F.struct("*").alias("row"), *ident)
    rows = rows.join(hits.withColumnsRenamed({"k": "hk", "th": "ht"}), F.col("k").eqNullSafe(F.col("hk")) & (F.col("th") == F.col("ht")), "left")
    body = F.coalesce(F.col("row")[text], F.lit(""))
    rows = rows.select("row", "bad", F.when(F.col("bad").isNotNull(), F.split(body, "\n")).alias("all"),
                       (F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"))
    rows = rows.withColumn("rest", F.filter("all", lambda x: ~(F.array_contains(F.col("bad"), _hash(x)) & _has_word(x))))
    return rows.select("row", "n_lines", F.coalesce(F.size("all") - F.size("rest"), F.lit(0)).cast("long").alias("n_removed"),
                       F.when(F.col("bad").isNotNull(), F.array_join("rest", "\n")).otherwise(F.col("row")[text]).alias("kept"))


def line_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES,
               keep_emptied: bool = True) -> DataFrame:
    """``docs`` with cross-site boilerplate lines taken out of the texts, but for each line's home: the document with
    the smallest id that holds it (all rows of that id; rows without id count as one last document).

    Rows and columns stay as they are, and so do null and empty texts. With ``keep_emptied`` off, documents that lose
    their last word go: each of their lines is still in its home."""
    marked = _marked(docs, key, text, site, min_sites)
    if not keep_emptied:
        marked = marked.where((F.col("n_removed") == 0) | _has_word(F.col("kept")))
    return marked.select(*[(F.col("kept") if c == text else F.col("row")[c]).alias(c) for c in docs.columns])


def line_report(docs: DataFrame, key: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_sha256) per document; the text left by ``line_dedup``, null as empty."""
    marked = _marked(docs.select(key, text, site), key, text, site, min_sites)
    return marked.select(F.col("row")[key].alias("doc_id"), "n_lines", "n_removed",
                         F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (SELECT doc_id, source, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line FROM documents),
bad AS (SELECT line, min(doc_id) AS home FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY line HAVING count(DISTINCT source) >= 10),
m AS (SELECT l.doc_id, count(*) AS n_lines, count(b.line) AS hit, string_agg(l.line, chr(10) ORDER BY i) FILTER (WHERE b.line IS NULL) AS cut
    FROM l LEFT JOIN bad b ON l.line = b.line AND l.doc_id <> b.home GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(m.n_lines, 1) AS n_lines, coalesce(m.hit, 0)::BIGINT AS n_removed,
    sha256(CASE WHEN m.hit > 0 THEN coalesce(m.cut, '') ELSE coalesce(d.text, '') END) AS kept_sha256 FROM documents d LEFT JOIN m USING (doc_id)
"""
