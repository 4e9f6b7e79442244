"""Language identification against plain Python, and held-out accuracy."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from lorekit.llm import language_id as L

SCHEMA = "doc_id long, text string, lang string, source string, held_out boolean, score double, code int, cell string, n long, lang_pred string"
M64 = (1 << 64) - 1


def make_docs(spark, rows):
    return spark.createDataFrame([(i, t, y, "s", True, 0.5, 1, "c", 2, "x") for i, t, y in rows], SCHEMA)


def clean(text):
    out = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    return f" {' '.join(out.split(' '))} " if not out.strip(" ") else " " + " ".join(x for x in out.split(" ") if x) + " "


def grams(text, buckets):
    points = [ord(c) for c in clean(text)]
    for n in range(1, 5):
        for i in range(len(points) - n + 1):
            h = points[i]
            for p in points[i + 1:i + n]:
                h = (h * 0x100000001B3 + p) & M64
            h = (h + (n << 60)) & M64
            h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & M64
            h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & M64
            yield (h ^ (h >> 31)) & (buckets - 1)


def fold(i):
    return None if i is None else zlib.crc32(str(i).encode()) % 3


def has_letter(text):
    return any(c.isalpha() for c in text or "")


def expected(rows):
    n, counts = Counter(), defaultdict(Counter)
    learn = [(t, y) for i, t, y in rows if fold(i) not in (None, 1) and y is not None and has_letter(t)]
    langs = sorted({y for _, y in learn})
    buckets = min(L.BUCKETS, 1 << int(math.log2(L.TABLE // max(len(langs), 1))))
    for t, y in learn:
        n[y] += 1
        counts[y].update(grams(t, buckets))
    out = []
    for i, t, _ in rows:
        if not langs or not has_letter(t):
            out.append((i, fold(i) == 1, "und", 0.0))
            continue
        seen, s = Counter(grams(t, buckets)), {}
        for y in langs:
            whole = math.log(sum(counts[y].values()) + L.SMOOTH * buckets)
            s[y] = math.log(n[y] / len(learn)) + sum(c * (math.log(counts[y][g] + L.SMOOTH) - whole) for g, c in seen.items())
        best = max(s.values())
        out.append((i, fold(i) == 1, next(y for y in langs if s[y] == best), 1 / sum(math.exp(v - best) for v in s.values())))
    return out


def check(got, want):
    order = lambda rows: sorted(((i is None, i or 0, h, y, p) for i, h, y, p in rows))
    got, want = order(map(tuple, got)), order(want)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert all(abs(a[4] - b[4]) < 1e-6 for a, b in zip(got, want))


def predicted(spark, rows):
    docs = make_docs(spark, rows)
    return L.predict(docs, L.train(docs)).collect()


def prose(rnd, letters, n):
    return " ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(2, 7))) for _ in range(n))


def messy():
    rnd = random.Random(4)
    letters = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "abcxyzäöß", "zz": "жзийабв"}
    rows = [(i, prose(rnd, letters[y], rnd.randint(1, 30)), y) for i in range(90) for y in [rnd.choice(list(letters))]]
    rows += [(None, "abc def", "aa"), (None, None, None), (200, None, "aa"), (201, "", "bb"), (202, "123 --- !!", "cc"), (203, "ABC. dEf!", None), (204, "é漢字▁ 🙂 x", "zz"),
             (205, "one", "only null texts"), (206, None, "no text"), (207, "  \n\t ", None), (208, "жж", "zz"), (208, "жж", "zz"), (209, "ab" * 3000, "aa"),
             (210, "..." + "q" * 5000 + "..." + "ß" * 200, None)]
    return rows


def test_messy_documents(spark, monkeypatch):
    rows = messy()
    check(predicted(spark, rows), expected(rows))
    monkeypatch.setattr(L, "SLICE", 100)                    # the n-grams over a slice's end are counted once
    check(predicted(spark, rows), expected(rows))


def test_more_languages_have_fewer_buckets(spark, monkeypatch):
    monkeypatch.setattr(L, "TABLE", 1 << 12)
    rows = messy()
    model = L.train(make_docs(spark, rows))
    assert model["table"].size <= 1 << 12 and model["table"].shape[1] == 512
    check(predicted(spark, rows), expected(rows))
    monkeypatch.setattr(L, "TABLE", 2 * L.FEWEST)
    with pytest.raises(ValueError, match="more than 2 languages"):
        L.train(make_docs(spark, rows))


@pytest.mark.parametrize("rows", [[], [(1, "abc", None), (2, None, "aa")], [(i, "same text", "xx") for i in range(6)],
                                  [(i, "same text", "xx" if i % 2 else "yy") for i in range(6)]])
def test_small_tables(spark, rows):
    check(predicted(spark, rows), expected(rows))


def test_other_columns_are_never_inputs(spark):
    rows = messy()
    docs = make_docs(spark, rows)
    model = L.train(docs)
    again = make_docs(spark, [(i, t, None) for i, t, _ in rows])
    order = lambda d: sorted(map(str, L.predict(d, model).collect()))
    assert order(docs) == order(again)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = L.predict(docs, L.train(docs)).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows) > 0
    assert all(0 <= r.score <= 1 for r in rows)
