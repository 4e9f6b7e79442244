"""Near-duplicate clusters against brute-force Jaccard on a small fixture."""

import itertools
import re

from lorekit.operators.duplicates import exact_duplicates, near_duplicates


def _shingles(t, k=3):
    w = re.findall(r"\S+", t.lower())
    return {" ".join(w[i:i + k]) for i in range(max(len(w) - k + 1, 1))}


def test_near_duplicates_brute_force(spark):
    base = "the quick brown fox jumps over the lazy dog near the river bank today and tomorrow again"
    texts = [base, base + " extra", base.replace("lazy", "sleepy"),
             "completely different words about databases and query planners",
             "completely different words about databases and query planners too",
             "unrelated sentence number one", "another unrelated line of text here"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["cluster"] for r in near_duplicates(df).collect()}
    for a, b in itertools.combinations(range(len(texts)), 2):
        sa, sb = _shingles(texts[a]), _shingles(texts[b])
        j = len(sa & sb) / len(sa | sb)
        if j >= 0.8:
            assert a in got and got.get(a) == got.get(b), (a, b, j)
        if j < 0.1:
            assert not (a in got and b in got and got[a] == got[b]), (a, b, j)


def test_exact_duplicates(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "doc_id long, text string")
    r = exact_duplicates(df).collect()
    assert len(r) == 1 and r[0]["n"] == 2 and r[0]["first"] == 1
