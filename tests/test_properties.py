"""Properties from SURVEY §5: idempotence, additivity, pairwise distances and
partition independence."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from lorekit.functions.text import redact
from lorekit.operators import lint
from lorekit.plans.catalog import QUERIES
from lorekit.plans.vault import Vault


def test_redact_idempotent(spark):
    d = Vault(spark, SF_SMALL)["documents"]
    once = d.select(redact("text").alias("t"))
    assert once.where(redact("t") != F.col("t")).count() == 0
    unchanged = d.where(~F.lower("text").rlike("api|token|secret|password|authorization|credential|auth"))
    assert unchanged.where(redact("text") != F.col("text")).count() == 0


def test_lint_all_is_sum_of_checks(spark):
    sf = "/root/testdata/sf0.01"
    total = QUERIES["lint_all"](spark, sf).count()
    parts = sum(QUERIES[k](spark, sf).count() for k in [
        "lint_broken_links", "lint_orphan_pages", "lint_orphan_sources", "lint_stale_articles",
        "lint_missing_backlinks", "lint_sparse_articles", "lint_projects_missing", "lint_unknown_aliases"])
    assert total == parts > 0


def test_reverse_edges_clear_backlinks(spark):
    v = Vault(spark, "/root/testdata/sf0.01")
    links = v["links"]
    rev = links.select(F.col("target").alias("src"), F.lit(0).alias("pos"), F.col("src").alias("raw"),
                       F.col("src").alias("target"), F.lit(False).alias("is_daily"))
    both = links.unionByName(rev)
    assert lint.lint_missing_backlinks(v["articles"], both).count() == 0


def test_throttle_outputs_are_spaced(spark):
    from lorekit.operators.observations import throttle
    obs = Vault(spark, SF_SMALL)["observations"]
    t = throttle(obs, "session_id", 3600).select("session_id", "ts", "seq")
    w = __import__("pyspark.sql", fromlist=["Window"]).Window.partitionBy("session_id").orderBy("ts", "seq")
    gaps = t.withColumn("prev", F.lag("ts").over(w)).where(F.col("prev").isNotNull())
    assert gaps.where(F.col("ts") < F.col("prev") + F.expr("INTERVAL 1 HOUR")).count() == 0
    firsts = obs.groupBy("session_id").agg(F.min_by("seq", F.struct("ts", "seq")).alias("seq"))
    assert firsts.join(t, ["session_id", "seq"], "left_anti").count() == 0


def test_upsert_confidence_bounds(spark):
    inst = QUERIES["upsert_instincts"](spark, SF_SMALL)
    bad = inst.where((F.col("evidence_count") >= 2) & (F.col("confidence") > 0.9))
    assert bad.count() == 0


def test_partition_independence(spark):
    names = ["lint_all", "running_tool_calls", "throttle", "session_context", "upsert_instincts", "backfill_projects"]
    base = {n: sorted(map(tuple, QUERIES[n](spark, SF_SMALL).collect())) for n in names}
    for parts in ("1", "2", "200"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            for n in names:
                assert sorted(map(tuple, QUERIES[n](spark, SF_SMALL).collect())) == base[n], (n, parts)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
