"""Secret redaction, secret findings and security-finding rollups."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from lorekit.functions.text import SECRET
from lorekit.session import cut_lineage

# ── Fixed values ──────────────────────────────────────────────────────
IGNORE_GLOBS = ("plugins/marketplaces/*",)
CRITICAL_SHOWN = 10
SEVERITY_MISSING = "unknown"


def secret_findings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per secret match: (key, ordinal, keyword, match). Documents without
    a key word are dropped by a cheap predicate before the extraction."""
    d = docs.where(F.col(text).rlike(SECRET)).select(
        F.col(key), F.regexp_extract_all(F.col(text), F.lit(SECRET), 1).alias("kw"),
        F.regexp_extract_all(F.col(text), F.lit(SECRET), 0).alias("m"))
    z = d.select(key, F.posexplode(F.arrays_zip("kw", "m")).alias("ordinal", "z"))
    return z.select(key, F.col("ordinal").cast("bigint").alias("ordinal"),
                    F.col("z.kw").alias("keyword"), F.col("z.m").alias("match"))


def severity_counts(findings: DataFrame) -> DataFrame:
    return (findings.groupBy(F.coalesce("severity", F.lit(SEVERITY_MISSING)).alias("severity"))
            .agg(F.count(F.lit(1)).alias("n")))


def glob_to_regex(glob: str) -> str:
    """fnmatch translation: ``*`` crosses ``/``, ``?`` one character, ``[..]`` a set."""
    out, i = ["^"], 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            j = glob.find("]", i + 2 if i + 1 < len(glob) and glob[i + 1] == "!" else i + 1)
            if j == -1:
                out.append(r"\[")
            else:
                body = glob[i + 1:j]
                if body.startswith("!"):
                    body = "^" + body[1:]
                out.append("[" + body.replace("\\", r"\\") + "]")
                i = j
        else:
            out.append(re.escape(c))
        i += 1
    out.append("$")
    return "(?s)" + "".join(out)


def is_ignored(globs=IGNORE_GLOBS, root: str = "") -> F.Column:
    """Whether the path of ``file`` relative to ``root`` matches any glob; never for a row without a file."""
    f = F.coalesce(F.col("file"), F.lit(""))
    prefix = root.rstrip("/") + "/" if root else None
    rel = (F.when(F.lit(prefix is not None) & f.startswith(prefix or "\u0000"), F.substring(f, len(prefix or "") + 1, 1 << 30))
           .otherwise(F.regexp_replace(f, "^/+", "")))
    hit = F.lit(False)
    for g in globs:
        hit = hit | rel.rlike(glob_to_regex(g))
    return (f != "") & hit


def ignore_findings(findings: DataFrame, globs=IGNORE_GLOBS, root: str = "", observation: Observation | None = None) -> DataFrame:
    """Findings without those whose path relative to ``root`` matches any glob; rows without a file are kept.

    An ``observation`` gets ``n_seen`` and ``n_dropped`` in the pass that reads the kept rows; both can be taken from it
    once that has run."""
    hit = is_ignored(globs, root)
    if observation is not None:
        findings = findings.observe(observation, F.count(F.lit(1)).alias("n_seen"), F.count_if(hit).alias("n_dropped"))
    return findings.where(~hit)


def ignored_report(findings: DataFrame, globs=IGNORE_GLOBS, root: str = "") -> DataFrame:
    """The kept findings, each with ``n_dropped``: how many were ignored. Findings are read once; the kept ones are
    written, and that pass counts the others."""
    seen = Observation("ignored findings")
    kept = cut_lineage(ignore_findings(findings, globs, root, seen))
    return kept.withColumn("n_dropped", F.lit(seen.get["n_dropped"]).cast("long"))


def critical_alerts(findings: DataFrame, scan_col: str = "scan", k: int = CRITICAL_SHOWN) -> DataFrame:
    """Per scan: the first ``k`` critical findings as alert lines plus an overflow
    line; location is ``file:line`` when a line is known. Spark plans the
    ``row_number <= k`` filter as a per-partition group limit."""
    c = findings.where(F.col("severity") == "critical")
    w = Window.partitionBy(scan_col).orderBy("file", "line", "hit_pos")
    counts = c.groupBy(scan_col).agg(F.count(F.lit(1)).alias("n_critical"))
    # row_number <= k directly on the window lets Spark plan a per-partition group limit
    c = c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).join(counts, scan_col)
    loc = F.when(F.col("line").isNotNull() & (F.col("line") != 0),
                 F.concat(F.coalesce("file", F.lit("?")), F.lit(":"), F.col("line").cast("string"))
                 ).otherwise(F.coalesce("file", F.lit("?")))
    shown = c.select(
        scan_col, F.col("rank").cast("bigint").alias("rank"),
        F.concat(F.lit("- **"), F.coalesce("title", F.lit("untitled")), F.lit("** ("),
                 F.coalesce("category", F.lit("-")), F.lit(") — "), loc).alias("line"))
    more = (c.where(F.col("rank") == 1).where(F.col("n_critical") > k)
            .select(scan_col, F.lit(k + 1).cast("bigint").alias("rank"),
                    F.concat(F.lit("- … and "), (F.col("n_critical") - k).cast("string"),
                             F.lit(" more critical findings")).alias("line")))
    return shown.unionByName(more)
