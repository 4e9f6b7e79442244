"""A day's logs are several files: the pointer and the one-hop back-fill take all of them."""

import datetime

from lorekit.operators.dailies import latest_daily_pointer

REGISTRY = [(1, "Alpha", ["al"], "alpha"), (2, "Beta", [], "beta")]
DAY = datetime.date(2024, 1, 30)


def _log(*headers):
    return "# Daily Log\n\n" + "".join(f"\n### Session ({at}) — {tag}\n\n- x\n" for at, tag in headers)


def _pointer(spark, logs):
    dailies = spark.createDataFrame([(n, d, c) for n, d, c in logs], "name string, date date, content string")
    registry = spark.createDataFrame(REGISTRY, "ord int, canonical string, aliases array<string>, name string")
    registry = registry.selectExpr("*", "'i' || ord AS id")
    return {r.project: (r.name, r.n_sessions, r.last_header) for r in latest_daily_pointer(dailies, registry, "2024-01-31 10:00:00").collect()}


def test_pointer_counts_all_logs_of_the_day(spark):
    logs = [("2024-01-30.md", DAY, _log(("08:00", "alpha"), ("09:00", "beta"))), ("2024-01-30-2.md", DAY, _log(("07:00", "al"))),
            ("2024-01-30-10.md", DAY, _log(("06:00", "alpha"), ("06:30", "all"))), ("2024-01-29-3.md", datetime.date(2024, 1, 29), _log(("23:00", "beta")))]
    assert _pointer(spark, logs) == {"Alpha": ("2024-01-30.md", 4, "Session (06:30) — all"), "Beta": ("2024-01-30.md", 2, "Session (06:30) — all")}
    assert _pointer(spark, logs[1:2])["Alpha"] == ("2024-01-30-2.md", 1, "Session (07:00) — al")
    assert _pointer(spark, []) == {}


def test_one_hop_takes_the_sections_of_all_logs_of_a_day(spark, tmp_dir):
    from lorekit.plans.catalog import QUERIES
    ts = datetime.datetime(2024, 1, 3, 5)
    tables = {"documents": ([(i, f"t{i}", f"src{i % 20}") for i in range(40)], "doc_id long, text string, source string"),
              "events": ([(i, ts, u, "view", '{"k": 1}') for i, u in enumerate((1, 58, 111))], "event_id long, ts timestamp, user_id long, event_type string, props string"),
              "conversations": ([(1, 0, "user", "x")], "conv_id long, turn int, role string, text string")}
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_dir}/{name}.parquet")
    got = {r.slug: r.projects_list for r in QUERIES["backfill_projects_one_hop"](spark, tmp_dir).collect()}
    assert {"Src1", "Src11", "src18"} <= set(got["concepts/doc-2"].split(" | "))
