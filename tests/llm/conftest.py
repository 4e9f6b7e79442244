import os
import random
import re
import sys

import pytest

sys.path.append(os.path.dirname(os.path.abspath(__file__)))      # the tests import each other's helpers

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = ("doc_id long, text string, source string, lang string, n_chars long, row string, chunk int, h long, n int, token string, "
          "component string, plan string, bucket int, size string, target string, copies string")


def words(text):
    return WORDS.findall(text or "")


def make(spark, rows):
    """Documents (doc_id, text, source) with more columns whose names the operators use inside."""
    return spark.createDataFrame([(d, t, s, None, None, "r", 7, 1, 2, "t", "c", "p", 3, "s", "x", "y") for d, t, s in rows], SCHEMA)


def prose(seed, n):
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def messy_rows():
    """Nulls, empty and very long texts, ties, repeated rows, shared passages and near copies."""
    passage, long_text = prose(1, 60), prose(2, 30000)
    near = prose(3, 400)
    rows = [(None, prose(4, 50), "a"), (None, None, None), (1, None, "a"), (2, "", "b"), (3, "one", None), (4, "one two", "c"),
            (5, long_text, "a"), (6, long_text, "b"), (7, prose(5, 30) + " " + passage + " " + prose(6, 30), "c"),
            (8, passage + "\n" + prose(7, 40), "a"), (9, prose(8, 40) + "\t" + passage, None), (9, prose(9, 45), "d"),
            (10, near, "a"), (11, near.replace(near.split()[200], "zz", 1), "b"), (12, near.upper(), "c"), (13, near, "d"), (13, near, "d"),
            (14, "ab " * 300, "a"), (15, "x" * 5000, "b"), (16, "é漢字▁ " * 40, "c"), (17, " \n\t ", "d"), (18, "a\n\na\n b\r\n" * 30, "a")]
    rows += [(100 + i, f"shared boilerplate line of text\n{prose(100 + i, 40)}\nsecond shared line", f"site{i % 14}") for i in range(28)]
    return rows
