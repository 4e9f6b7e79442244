"""Token files and the Viterbi encoder: brute force and exact round trips."""

from collections import Counter

import numpy as np
import pytest

from lorekit.llm import sentencepiece_viterbi as S
from lorekit.llm import token_counts as T
from tests_llm import make


@pytest.fixture(scope="module")
def enc():
    with open(T.TOKENIZER, "rb") as f:
        return T.encoder(f.read())


@pytest.mark.parametrize("block", [7, 1000, 1 << 20])
def test_counts_of_messy_rows(spark, messy_rows, enc, block):
    got = T.document_token_counts(make(spark, messy_rows), block_tokens=block).collect()
    assert Counter(map(tuple, got)) == Counter((d, len(enc.encode_ordinary(t or ""))) for d, t, _ in messy_rows)


def test_counts_of_an_empty_table(spark):
    assert T.document_token_counts(make(spark, [])).count() == 0


@pytest.mark.parametrize("stretch", [2, 4096])
def test_raw_files(spark, tmp_path, monkeypatch, stretch):
    """Documents across many blocks, blocks without separators, separators at block edges, an open end, an empty file."""
    monkeypatch.setattr(T, "STRETCH", stretch)
    files = {"a.bin": [3, 0, 0, 40, 8, 7], "b.bin": [100], "c.bin": [], "d.bin": [7, 7, 0]}
    want = Counter()
    for name, sizes in files.items():
        stream = np.concatenate([np.zeros(0, np.uint16), *[np.append(np.arange(n) % 100, T.EOD) for n in sizes]]).astype(np.uint16)
        if name == "d.bin":
            stream = np.append(stream, [5, 6, 9]).astype(np.uint16)
            want[(name, len(sizes), 3, False)] += 1
        (tmp_path / name).write_bytes(stream.tobytes())
        want.update((name, i, n, True) for i, n in enumerate(sizes))
    got = T.token_counts(T.flat_blocks(spark, str(tmp_path), block_tokens=8)).collect()
    assert Counter((r.file.rsplit("/", 1)[1], r.ordinal, r.n_tokens, r.ended) for r in got) == want


def brute(word, scores, pieces):
    best, back = [0.0] + [-np.inf] * len(word), [None] * (len(word) + 1)
    for e in range(1, len(word) + 1):
        for k in range(1, min(pieces.longest, e) + 1):
            p = word[e - k:e]
            s = scores[p][0] if p in scores else pieces.unknown if k == 1 else -np.inf
            if best[e - k] + s > best[e]:
                best[e], back[e] = best[e - k] + s, p
    out, e = [], len(word)
    while e:
        p = back[e]
        raw = chr(S.SPACE) if p == chr(S.ESCAPED - 1) else p
        out = ([scores[p][1]] if p in scores else [int(pieces.byte_ids[b]) for b in raw.encode()]) + out
        e -= len(p)
    return out


def test_encoding_of_messy_rows(spark, messy_rows):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=S.MODEL)
    pieces = S.load_pieces()
    scores = {sp.id_to_piece(i): (sp.get_score(i), i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    got = S.encode(make(spark, messy_rows))
    want, memo = Counter(), {}
    for d, t, _ in messy_rows:
        ids = []
        for w in (t or "").replace(chr(S.SPACE), chr(S.ESCAPED - 1)).split(" ") if t else []:
            ids += memo.setdefault(w, None) or memo.__setitem__(w, brute(chr(S.SPACE) + w, scores, pieces)) or memo[w]
        want[(d, len(ids), tuple(ids), True)] += 1
    assert Counter((r.doc_id, r.n_tokens, tuple(r.token_ids), r.round_trip) for r in got.collect()) == want
    back = S.decode(got.select("doc_id", "token_ids"))
    assert Counter(map(tuple, back.collect())) == Counter((d, t or "") for d, t, _ in messy_rows)


def test_cache_may_be_forgotten(monkeypatch):
    raw = lambda s: (np.array([0, len(s.encode())]), np.frombuffer(s.encode(), np.uint8))
    texts = ["some words here", "other words there", "some words again", "more of other"]
    want = [S.Encoder(S.load_pieces()).block(*raw(t))[1].tolist() for t in texts]
    monkeypatch.setattr(S, "CACHE_WORDS", 2)
    one = S.Encoder(S.load_pieces())
    assert [one.block(*raw(t))[1].tolist() for t in texts] == want


def test_no_rows_and_no_ids(spark):
    assert S.encode(make(spark, [])).count() == 0
    assert [tuple(r) for r in S.decode(spark.createDataFrame([(1, None), (2, [])], "doc_id long, token_ids array<int>")).collect()] == [(1, ""), (2, "")]
