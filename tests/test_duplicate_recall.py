"""How much of the exact relation near duplicates find: pairs by exact Jaccard similarity against clusters."""

import random
from collections import defaultdict

from lorekit.operators.duplicates import near_duplicates


def shingles(text, n):
    w = text.lower().split()
    return {tuple(w[i:i + n]) for i in range(max(len(w) - n + 1, 1))} if w else set()


def similar_pairs(texts, n, least):
    """All pairs with Jaccard similarity of at least ``least``, by way of shared shingles."""
    sets, by = {k: shingles(t, n) for k, t in texts.items()}, defaultdict(list)
    for k, s in sets.items():
        for x in s:
            by[x].append(k)
    seen = {(a, b) for ks in by.values() if len(ks) <= 200 for i, a in enumerate(ks) for b in ks[:i]}
    return [(a, b) for a, b in seen if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])]


def recall(spark, texts, n, least, **kw):
    rows = near_duplicates(spark.createDataFrame(list(texts.items()), "key string, text string"), key="key", text="text", shingle=n, **kw).collect()
    cluster = {r.key: r.cluster for r in rows}
    pairs = similar_pairs(texts, n, least)
    return sum(a in cluster and cluster[a] == cluster.get(b) for a, b in pairs) / len(pairs), len(pairs), cluster


def test_recall_on_edited_instincts(spark):
    """2,000 instincts, 400 of them with four edited versions each."""
    rnd, texts = random.Random(11), {}
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(5))
    for g in range(400):
        base = [word() for _ in range(rnd.randint(14, 24))]
        for v in range(5):
            w = list(base)
            if v:
                w[rnd.randrange(len(w))] = word()
            texts[f"i{g}-{v}"] = " ".join(w)
    for md5_hash in (False, True):
        share, n, cluster = recall(spark, texts, 2, 0.7, md5_hash=md5_hash)
        assert share >= 0.9 and n > 2000
        assert all(k.split("-")[0] == c.split("-")[0] for k, c in cluster.items())      # no cluster joins two groups


def test_recall_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    share, n, _ = recall(spark, {str(r.doc_id): r.text for r in docs if r.text}, 3, 0.8)
    assert share >= 0.9 and n > 50
