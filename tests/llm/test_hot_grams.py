"""A passage in many documents between words of their own: its grams are split over groups of bounded size."""

import random
from collections import Counter

import pytest

from lorekit.llm import passages
from lorekit.llm import substring_dedup as S
from lorekit.llm import suffix_dedup as SD
from test_passages import expected
from tests_llm import make, prose


@pytest.mark.parametrize("unit,f,size,window", [("word", S.substring_dedup, "n_words", 20), ("byte", SD.suffix_dedup, "n_bytes", 400)])
def test_edges_of_a_shared_passage(spark, monkeypatch, unit, f, size, window):
    monkeypatch.setattr(passages, "SHARD_KINDS", {"word": 16, "byte": 16}, raising=False)
    kinds, passage, rnd = spark.sparkContext.accumulator(0), prose(1, 150), random.Random(3)
    groups = spark.sparkContext.accumulator(0)
    resolve = S.windows_seen if unit == "word" else SD.windows_elsewhere

    def counting(found, window):
        groups.add(1)
        if max(map(len, found)) > 60:
            kinds.add(1)
        return resolve(found, window)
    monkeypatch.setattr(S if unit == "word" else SD, resolve.__name__, counting)
    w = passage.split()
    rows = [(i, prose(100 + i, 5 + i % 40) + " " + " ".join(w[rnd.randrange(3) * 5:145 + rnd.randrange(2) * 5]) + " " + prose(400 + i // 2, 30), "a")
            for i in range(160)]
    got = f(make(spark, rows)).select("doc_id", size, "n_removed", "n_spans", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == expected(rows, window, unit)
    assert groups.value > 8 and kinds.value == 0         # no group holds more than about two blocks of a gram
