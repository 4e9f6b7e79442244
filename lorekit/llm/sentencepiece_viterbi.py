"""SentencePiece encoding and decoding by a batched numpy Viterbi.

The best segmentation of a word maximises the sum of its pieces' scores. Distinct words of a block are grouped by
length; all words of a length advance together, one position a round. Substring hashes probe the sorted keys of the
pieces (behind a bit table that rules most of them out), and vectorised maxima store the backpointers.

A space becomes U+2581 and starts a word; each text gets one in front, which decoding takes off. A character that no
piece covers falls back to its UTF-8 bytes; so does a U+2581 of the text, so every text decodes to itself."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekit.llm.textblocks import mix, prefix_hash, ragged, range_hash, text_blocks

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE, ESCAPED = 0x2581, 0x110000
UNKNOWN_PENALTY = 10.0
PROBE_BITS = 22
CACHE_WORDS = 500_000
CELLS = 1 << 22                  # substrings probed at once


def code_hashes(codes: np.ndarray) -> np.ndarray:
    return mix(codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))


class Pieces:
    """Sorted piece keys, scores and ids for encoding; the bytes of every id for decoding."""

    def __init__(self, pieces: list[tuple[str, float, str]]):
        """pieces: (text, score, kind) by id; kind is "piece", "byte" or "none" (control, unknown, unused)."""
        usable = [(p, s, i) for i, (p, s, kind) in enumerate(pieces) if kind == "piece"]
        size = np.array([len(p) for p, _, _ in usable])
        codes = np.frombuffer("".join(p for p, _, _ in usable).encode("utf-32-le"), np.uint32)
        end = np.cumsum(size)
        keys = range_hash(prefix_hash(code_hashes(codes)), end - size, end)
        order = np.argsort(keys)
        self.keys, self.longest = keys[order], int(size.max())
        self.scores = np.array([s for _, s, _ in usable], np.float64)[order]
        self.ids = np.array([i for _, _, i in usable], np.int32)[order]
        assert (self.keys[1:] != self.keys[:-1]).all()
        self.maybe = np.zeros(1 << PROBE_BITS, bool)
        self.maybe[self.keys >> np.uint64(64 - PROBE_BITS)] = True
        self.unknown = float(self.scores.min()) - UNKNOWN_PENALTY
        self.byte_ids = np.zeros(256, np.int32)
        texts = []
        for i, (p, _, kind) in enumerate(pieces):
            if kind == "byte":
                value = int(p[1:-1], 16)
                self.byte_ids[value] = i
                texts.append(bytes([value]))
            else:
                texts.append(p.replace(chr(SPACE), " ").encode() if kind == "piece" else b"")
        self.raw = np.frombuffer(b"".join(texts), np.uint8)
        self.end = np.cumsum([len(t) for t in texts])
        self.size = np.diff(np.append(0, self.end))

    def probe(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score, id) of each hash; minus infinity and -1 where it is no piece."""
        score, ids = np.full(h.shape, -np.inf), np.full(h.shape, -1, np.int32)
        maybe = np.nonzero(self.maybe[h >> np.uint64(64 - PROBE_BITS)])
        x = h[maybe]
        at = np.minimum(np.searchsorted(self.keys, x), len(self.keys) - 1)
        hit = self.keys[at] == x
        maybe = tuple(m[hit] for m in maybe)
        score[maybe], ids[maybe] = self.scores[at[hit]], self.ids[at[hit]]
        return score, ids


def load_pieces(model: str = MODEL) -> Pieces:
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    kind = lambda i: "byte" if sp.is_byte(i) else "none" if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else "piece"
    return Pieces([(sp.id_to_piece(i), sp.get_score(i), kind(i)) for i in range(sp.get_piece_size())])


def segment(prefix: np.ndarray, codes: np.ndarray, start: np.ndarray, length: int, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(tokens per word, tokens) of words of one length; a token below 0 stands for the character -1 - token."""
    n = len(start)
    best = np.full((n, length + 1), -np.inf)
    best[:, 0] = 0
    back, token = np.zeros((n, length + 1), np.int8 if pieces.longest < 128 else np.int32), np.zeros((n, length + 1), np.int32)
    probes = []
    for k in range(1, min(pieces.longest, length) + 1):
        at = start[:, None] + np.arange(length - k + 1)
        score, ids = pieces.probe(range_hash(prefix, at, at + k))
        if k == 1:
            lost = ids < 0
            score[lost] = pieces.unknown
            ids[lost] = -1 - codes[at][lost].astype(np.int64)
        probes.append((score, ids))
    for e in range(1, length + 1):
        for k in range(1, min(len(probes), e) + 1):
            score, ids = probes[k - 1]
            total = best[:, e - k] + score[:, e - k]
            better = total > best[:, e]
            if better.any():
                best[better, e], back[better, e], token[better, e] = total[better], k, ids[better, e - k]
    out, used = np.zeros((n, length), np.int32), np.zeros((n, length), bool)
    at = np.full(n, length)
    rows = np.arange(n)
    while len(rows):
        out[rows, at[rows] - 1], used[rows, at[rows] - 1] = token[rows, at[rows]], True
        at[rows] -= back[rows, at[rows]]
        rows = rows[at[rows] > 0]
    return used.sum(axis=1), out[used]


def with_bytes(count: np.ndarray, tokens: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Characters without a piece become the ids of their UTF-8 bytes."""
    lost = np.flatnonzero(tokens < 0)
    if not len(lost):
        return count, tokens
    char = -1 - tokens[lost].astype(np.int64)
    char[char == ESCAPED] = SPACE
    raw = [chr(c).encode() for c in char]
    size = np.ones(len(tokens), np.int64)
    size[lost] = [len(r) for r in raw]
    out = np.repeat(tokens, size)
    where = np.repeat(tokens < 0, size)
    out[where] = pieces.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
    word = np.repeat(np.arange(len(count)), count)
    return np.bincount(word, size, len(count)).astype(np.int64), out


def encode_words(codes: np.ndarray, prefix: np.ndarray, start: np.ndarray, size: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(tokens per word, tokens) of words given by their place."""
    count, parts = np.zeros(len(start), np.int64), []
    order = np.argsort(size, kind="stable")
    edge = np.append(np.flatnonzero(np.append(True, np.diff(size[order]) > 0)), len(order)) if len(order) else [0]
    for lo, hi in zip(edge[:-1], edge[1:]):
        length = int(size[order[lo]])
        step = max(1, CELLS // (length * min(length, pieces.longest)))
        for a in range(lo, hi, step):
            word = order[a:min(a + step, hi)]
            n, t = with_bytes(*segment(prefix, codes, start[word], length, pieces), pieces)
            count[word] = n
            parts.append((word, n, t))
    first = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.int32)
    for word, n, t in parts:
        out[ragged(first[word], n)] = t
    return count, out


class Encoder:
    """Encodes blocks; keeps the tokens of up to ``CACHE_WORDS`` words seen."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.forget()

    def forget(self):
        self.known, self.count, self.first = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.tokens = np.zeros(0, np.int32)

    def block(self, offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens per row, tokens) of a block's rows."""
        rows = len(offsets) - 1
        filled = np.flatnonzero(np.diff(offsets) > 0)
        if not len(filled):
            return np.zeros(rows, np.int64), np.zeros(0, np.int32)
        raw = np.insert(raw, offsets[filled], 0x20)
        head = offsets[filled] + np.arange(len(filled))
        chars_before = np.cumsum((raw & 0xC0) != 0x80) - 1
        codes = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32).copy()
        codes[codes == SPACE] = ESCAPED
        start = np.flatnonzero(codes == 0x20)
        codes[start] = SPACE
        size = np.diff(np.append(start, len(codes)))
        prefix = prefix_hash(code_hashes(codes))
        h = range_hash(prefix, start, start + size)
        keys, one, which = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, keys)
        new = np.append(self.known, np.uint64(0))[at] != keys if len(self.known) else np.ones(len(keys), bool)
        if new.any():
            count, tokens = encode_words(codes, prefix, start[one[new]], size[one[new]], self.pieces)
            if len(self.known) > CACHE_WORDS:
                self.forget()
                new = np.ones(len(keys), bool)
                count, tokens = encode_words(codes, prefix, start[one], size[one], self.pieces)
            known = np.concatenate([self.known, keys[new]])
            order = np.argsort(known, kind="stable")
            self.first = np.concatenate([self.first, len(self.tokens) + np.cumsum(count) - count])[order]
            self.count, self.known = np.concatenate([self.count, count])[order], known[order]
            self.tokens = np.concatenate([self.tokens, tokens])
        word = np.searchsorted(self.known, keys)[which]
        tokens = self.tokens[ragged(self.first[word], self.count[word])]
        words = np.diff(np.append(np.searchsorted(start, chars_before[head]), len(start)))
        per_row = np.zeros(rows, np.int64)
        total = np.append(0, np.cumsum(self.count[word]))
        edge = np.append(0, np.cumsum(words))
        per_row[filled] = total[edge[1:]] - total[edge[:-1]]
        return per_row, tokens


def decode_rows(count: np.ndarray, tokens: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(bytes per row, bytes) of rows of ids."""
    size = pieces.size[tokens]
    raw = pieces.raw[ragged(pieces.end[tokens] - size, size)]
    total = np.append(0, np.cumsum(size))
    edge = np.append(0, np.cumsum(count))
    begin, end = total[edge[:-1]], total[edge[1:]]
    drop = begin[(end > begin)]
    drop = drop[raw[drop] == 0x20]
    keep = np.ones(len(raw), bool)
    keep[drop] = False
    length = end - begin - np.isin(begin, drop) * (end > begin)
    return length, raw[keep]


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str = MODEL) -> DataFrame:
    """(doc_id, n_tokens, token_ids, round_trip) per row; round_trip tells whether the ids decode to the text.

    A null text is empty and has no ids. Rows are encoded one by one, whatever their ids; other columns are not
    read. The model file is read by the driver and sent to the tasks (about 5 MB)."""
    pieces = docs.sparkSession.sparkContext.broadcast(load_pieces(model))

    def f(batches):
        encoder = Encoder(pieces.value)
        for batch in batches:
            for lo, offsets, raw in text_blocks(batch.column("text")):
                count, tokens = encoder.block(offsets, raw)
                size, back = decode_rows(count, tokens, pieces.value)
                same = np.array_equal(size, np.diff(offsets)) and np.array_equal(back, raw)
                if same:
                    ok = np.ones(len(count), bool)
                else:
                    end = np.cumsum(size)
                    ok = np.array([np.array_equal(back[e - s:e], raw[a:b]) for e, s, a, b in zip(end, size, offsets[:-1], offsets[1:])], bool)
                ids = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)).astype(np.int32)), pa.array(tokens))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, len(count)), pa.array(count), ids, pa.array(ok)],
                                                 ["doc_id", "n_tokens", "token_ids", "round_trip"])
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        f, "doc_id long, n_tokens long, token_ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, spark: SparkSession | None = None, key: str = "doc_id", ids: str = "token_ids", model: str = MODEL) -> DataFrame:
    """(doc_id, text) of (doc_id, token_ids) rows; no ids give the empty text, bytes that are no UTF-8 U+FFFD."""
    pieces = (spark or encoded.sparkSession).sparkContext.broadcast(load_pieces(model))

    def f(batches):
        for batch in batches:
            col = batch.column("ids").cast(pa.list_(pa.int32())).fill_null([])
            count = np.diff(col.offsets.to_numpy()).astype(np.int64)
            size, raw = decode_rows(count, col.flatten().to_numpy(zero_copy_only=False), pieces.value)
            end, data = np.cumsum(size), raw.tobytes()
            texts = [data[e - s:e].decode("utf-8", "replace") for e, s in zip(end, size)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])
    return encoded.select(F.col(key).cast("long").alias("doc_id"), F.col(ids).cast("array<int>").alias("ids")).mapInArrow(f, "doc_id long, text string")
