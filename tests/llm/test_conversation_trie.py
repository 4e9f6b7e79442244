"""The conversation trie against a plain dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lorekit.llm import conversation_trie as T
from tests_llm import words

SCHEMA = "conv_id long, turn long, role string, text string, digest string, words int, pos string, lot int, seq string, ends string"


def make_turns(spark, rows):
    return spark.createDataFrame([(*r, "d", 1, "p", 2, "s", "e") for r in rows], SCHEMA)


def rebuilt(rows):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, r or "", x or ""))
    convs = {c: [t[2:] for t in sorted(v)] for c, v in convs.items()}
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        donor = c - (c % 20 if c >= 0 else -(-c % 20))
        out[c] = tuple(convs.get(donor, [])[:h] + own[h:])
    return out


def expected(rows):
    convs = rebuilt(rows)
    member, ends = defaultdict(list), defaultdict(list)
    for c, seq in convs.items():
        ends[seq].append(c)
        for d in range(len(seq) + 1):
            member[seq[:d]].append(c)
    kids, leaves, saved = Counter(p[:-1] for p in member if p), Counter(), Counter()
    for p, ids in member.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(ids) - 1) * len(words(p[-1][1])) if p else 0
    return Counter((min(ids), len(p), min(member[p[:-1]]) if p else None, len(ids), kids[p], leaves[p], saved[p],
                    hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, ids in member.items())


def got(spark, rows, **more):
    return Counter(map(tuple, T.conversation_trie(make_turns(spark, rows), **more).collect()))


def tree_rows(seed, convs, most=6, kinds=3):
    rnd = random.Random(seed)
    return [(c, t, rnd.choice(["user", "assistant"]), f"{rnd.randrange(kinds)} said so") for c in range(convs) for t in range(rnd.randint(1, most))]


def messy():
    rows = tree_rows(1, 60)
    rows += [(None, 1, "user", "nobody"), (200, None, "user", "first"), (200, 1, None, None), (200, 1, "", ""), (201, 1, "user", "a b"), (201, 1, "user", "a b"),
             (202, 5, "b", "x"), (202, 5, "a", "y"), (203, 1, "user", "w " * 20000), (-7, 1, "user", "0 said so"), (-20, 1, "user", "0 said so"), (-20, 2, "user", "1 said so")]
    rows += [(300 + i, t, "user", f"turn {t}") for i in range(40) for t in range(5)]              # copies
    rows += [(400, t, "user", f"turn {t}") for t in range(300)]                                  # a long one that goes on from them
    return rows


@pytest.mark.parametrize("lot_bytes", [700, 5000, T.LOT_BYTES])
def test_messy_conversations_whatever_the_lots(spark, lot_bytes):
    rows = messy()
    assert got(spark, rows, lot_bytes=lot_bytes) == expected(rows)


def test_turnless_conversations(spark):
    gone = [c for c in range(1, 200) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3][:3]
    rows = [(c, 0, "user", "x") for c in gone]                          # their donors are absent and h takes all they have
    assert got(spark, rows) == expected(rows) == Counter([(gone[0], 0, None, 3, 0, 1, 0, hashlib.sha256(",".join(map(str, gone)).encode()).hexdigest())])


def test_no_conversations(spark):
    assert got(spark, []) == Counter() and got(spark, [(None, 1, "user", "x")]) == Counter()


def test_a_third_of_the_conversations_alike(spark):
    rows = [(c, t, "user", f"same {t}" if c % 3 == 0 or t < 2 else f"own {c % 7} {t}") for c in range(300) for t in range(6)]
    assert got(spark, rows, lot_bytes=1500) == expected(rows)


def test_ids_of_a_group_are_joined_piece_by_piece(spark):
    members = spark.range(0, 20_000, 3).selectExpr("id AS conv_id", "CAST('s' AS binary) AS seq")
    want = hashlib.sha256(",".join(str(i) for i in range(0, 20_000, 3)).encode()).hexdigest()
    assert [tuple(r) for r in T.member_digests(members).collect()] == [(bytearray(b"s"), want)]


def test_extents_by_the_table():
    rnd = np.random.default_rng(3)
    for n in (0, 1, 2, 7, 64, 65):
        lcp = rnd.integers(0, 4, n)
        table = T.sparse_table(lcp)
        start, depth = rnd.integers(0, n + 1, 50), rnd.integers(0, 5, 50)
        for s, d, left, right in zip(start, depth, T.left_extent(table, start, depth), T.right_extent(table, start, depth)):
            assert left == next((i for i in range(s, 0, -1) if lcp[i - 1] < d), 0)
            assert right == next((i for i in range(s, n) if lcp[i] < d), n)
