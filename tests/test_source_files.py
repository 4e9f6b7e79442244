"""Sources and sinks on files: splittable transcripts, missing paths, the issue document, observed drops."""

import glob
import json
import os
import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from lorekit.operators.secrets import ignore_findings, ignored_report
from lorekit.operators.transcripts import flatten_turns, scan_transcripts
from lorekit.sources import scan


def transcript(seed, n):
    rnd = random.Random(seed)
    return [json.dumps({"message": {"role": "user", "content": "x" * rnd.randrange(200) + f" é{i}"}}, ensure_ascii=False) if rnd.random() < 0.9 else rnd.choice(["", "broken {", "\t"])
            for i in range(n)]


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_a_large_transcript_is_many_tasks(spark, tmp_dir, small_splits):
    files = {"big": transcript(1, 4000), "tiny +one": transcript(2, 3), "other": transcript(3, 700), "empty": [], "same.name": transcript(4, 40)}
    for name, lines in files.items():
        with open(os.path.join(tmp_dir, f"{name}.jsonl"), "w") as f:
            f.write("\n".join(lines) + ("\n" if lines and name != "other" else ""))
    got = scan_transcripts(spark, tmp_dir)
    rows = got.collect()
    assert sorted((r.session_id, r.seq, r.line) for r in rows) == sorted((s, i, x) for s, lines in files.items() for i, x in enumerate(lines))
    where = got.select("session_id", F.spark_partition_id().alias("p")).distinct().groupBy("session_id").count().collect()
    assert {r["session_id"]: r["count"] for r in where}["big"] > 10
    assert flatten_turns(got).where("session_id = 'big'").count() == sum(x.startswith("{") for x in files["big"])


def test_missing_paths_give_no_rows(spark, tmp_dir):
    gone = os.path.join(tmp_dir, "gone")
    for rows in (scan_transcripts(spark, gone), flatten_turns(scan_transcripts(spark, gone)), scan.scan_observations(spark, gone), scan.scan_findings(spark, gone)):
        assert rows.count() == 0 and len(rows.columns) > 2


ISSUES = "severity string, check string, file string, detail string, pos int"


@pytest.mark.parametrize("n", [0, 1, 200])
def test_issue_document(spark, tmp_dir, n):
    rnd = random.Random(n)
    rows = [(rnd.choice(["error", "warning"]), rnd.choice(["sparse_article", "broken_link", "own check"]), f"concepts/{rnd.randrange(40):03d}.md", rnd.choice(["é \"d\"", None, "x\ny"]), 0)
            for _ in range(n)]
    rows += rows[:3]                                             # repeated issues count each
    path = os.path.join(tmp_dir, "doc")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    scan.write_issues(spark.createDataFrame(rows, ISSUES).repartition(5), path, fmt="document")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    parts = sorted(glob.glob(os.path.join(path, "part-*")))
    doc = json.loads("".join(open(p).read() for p in parts))
    key = lambda i: (i["severity"], i["check"], i["file"], i["detail"] or "")
    assert doc["count"] == len(rows) and sorted(map(key, doc["issues"])) == sorted((a, b, c, d or "") for a, b, c, d, _ in rows)
    order = ["broken_link", "sparse_article", "own check"]
    assert [(order.index(i["check"]), i["file"]) for i in doc["issues"]] == sorted((order.index(i["check"]), i["file"]) for i in doc["issues"])
    assert n < 200 or len(parts) > 1


def test_ignored_findings_are_counted_in_the_same_pass(spark):
    rows = [("plugins/marketplaces/x/a.md",), ("/plugins/marketplaces/y.md",), ("src/plugins/marketplaces/z.md",), (None,), ("",)]
    f = spark.createDataFrame(rows, "file string")
    seen = Observation("drops")
    assert ignore_findings(f, observation=seen).count() == 3 and seen.get == {"n_seen": 5, "n_dropped": 2}
    assert sorted((r.file or "", r.n_dropped) for r in ignored_report(f).collect()) == [("", 2), ("", 2), ("src/plugins/marketplaces/z.md", 2)]
