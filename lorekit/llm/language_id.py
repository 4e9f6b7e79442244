"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased and its runs of other characters than letters become one space; its features are the n-grams of
one to ORDERS code points of what is left, hashed into buckets. Learning counts buckets per language over all learning
documents (each task sends its non-zero counts). The table of log-probabilities, languages by buckets, has at most
TABLE entries and is broadcast. A batch of texts is scored as a sparse product: bucket numbers row after row, whose
table entries are summed by row, a language at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekit.llm.textblocks import mix, text_blocks

ORDERS = 4
BUCKETS, FEWEST = 1 << 16, 1 << 6
TABLE = 1 << 22                  # entries of languages x buckets, 32 MB
SLICE = 1 << 18                  # code points hashed at once
SMOOTH = 0.5
UNKNOWN = "und"


def plain(text: Column) -> Column:
    """Lower-cased words of letters between single spaces; null for a text without a letter."""
    words = F.trim(F.regexp_replace(F.lower(text), r"\P{L}+", " "))
    return F.when(F.length(words) > 0, F.concat(F.lit(" "), words, F.lit(" ")))


def learning_fold(key: Column) -> Column:
    """Rows to learn from; a row without id is neither one of them nor held out."""
    return F.coalesce(F.crc32(key.cast("string")) % 3 != 1, F.lit(False))


def code_points(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first code point of each row and the end, code points) of UTF-8 rows."""
    starts = np.append(0, np.cumsum((raw & 0xC0) != 0x80))
    return starts[offsets], np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)


def ngram_slices(starts: np.ndarray, points: np.ndarray, buckets: int):
    """(row numbers, bucket numbers) of all n-grams of the rows, by order and slice; rows rise within each."""
    ends = starts[1:]
    for lo in range(0, len(points), SLICE):
        part = points[lo:lo + SLICE + ORDERS - 1].astype(np.uint64)
        n = min(SLICE, len(points) - lo)
        row = np.searchsorted(starts, np.arange(lo, lo + n), side="right") - 1
        room = ends[row] - np.arange(lo, lo + n)                        # code points up to the row's end
        h = part.copy()
        for order in range(1, ORDERS + 1):
            if order > 1:
                h = h[:-1] * np.uint64(0x100000001B3) + part[order - 1:]
            fits = room[:len(h)] >= order
            yield row[:len(h)][fits], (mix(h[:n][fits] + np.uint64(order << 60)) & np.uint64(buckets - 1)).astype(np.int64)


def _counted(languages: int, buckets: int):
    """Bucket counts of the batches of one task, summed before they are sent."""
    def f(batches):
        counts = np.zeros(languages * buckets, np.int64)
        for b in batches:
            code = b.column("code").to_numpy()
            for lo, offsets, raw in text_blocks(b.column("text")):
                for row, bucket in ngram_slices(*code_points(offsets, raw), buckets):
                    counts += np.bincount(code[lo + row] * buckets + bucket, minlength=len(counts))
        at = np.flatnonzero(counts)
        for lo in range(0, len(at), 1 << 16):
            cell = at[lo:lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(counts[cell])], ["cell", "n"])
    return f


def log_table(documents: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log prior per language, log-probability per language and bucket) of smoothed counts."""
    mass = counts + SMOOTH
    return np.log(documents / documents.sum()), np.log(mass) - np.log(mass.sum(axis=1, keepdims=True))


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> dict:
    """{langs, prior, table} from all documents of the learning folds that have a language and a letter. More languages
    mean fewer buckets; more than TABLE / FEWEST distinct ones are no languages and raise an error."""
    rows = docs.where(learning_fold(F.col(key)) & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    most = TABLE // FEWEST
    found = rows.groupBy("lang").count().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} languages")
    found = sorted((r["lang"], r["count"]) for r in found)
    langs = [x for x, _ in found]
    if not langs:
        return {"langs": [], "prior": np.zeros(0), "table": np.zeros((0, FEWEST))}
    buckets = min(BUCKETS, 1 << (TABLE // len(langs)).bit_length() - 1)
    codes = docs.sparkSession.createDataFrame([(x, i) for i, x in enumerate(langs)], "lang string, code int")
    counted = rows.join(F.broadcast(codes), "lang").select("code", plain(F.col("text")).alias("text")).mapInArrow(_counted(len(langs), buckets), "cell int, n long")
    sums = counted.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(langs) * buckets)
    counts[sums["cell"].to_numpy()] = sums["n"].to_numpy()
    prior, table = log_table(np.array([n for _, n in found], float), counts.reshape(len(langs), buckets))
    return {"langs": langs, "prior": prior, "table": table}


def block_scores(model: dict, offsets: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log-likelihood plus prior of each language (rows) for each text of a block (columns)."""
    rows = len(offsets) - 1
    out = np.repeat(model["prior"][:, None], rows, axis=1)
    for row, bucket in ngram_slices(*code_points(offsets, raw), model["table"].shape[1]):
        if len(row):
            first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            for scores, logs in zip(out, model["table"]):
                scores[row[first]] += np.add.reduceat(logs[bucket], first)
    return out


def _predicted(shared, langs: list[str]):
    names = np.array([*langs, UNKNOWN], object)

    def f(batches):
        prior, table = shared.value
        model = {"prior": prior, "table": table}
        for b in batches:
            for lo, offsets, raw in text_blocks(b.column("text")):
                n = len(offsets) - 1
                pred, score = np.full(n, len(langs)), np.zeros(n)
                known = np.flatnonzero(np.diff(offsets)) if langs else np.zeros(0, int)
                if len(known):
                    s = block_scores(model, offsets, raw)[:, known]
                    pred[known] = s.argmax(axis=0)
                    score[known] = 1 / np.exp(s - s.max(axis=0)).sum(axis=0)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, n), b.column("held_out").slice(lo, n), pa.array(names[pred], pa.string()), pa.array(score)],
                                                 ["doc_id", "held_out", "lang_pred", "score"])
    return f


def predict(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per row: the likeliest language (the first by name of equals) and its
    posterior probability. A null text, or one without a letter, is ``und`` with score 0, as is every text where
    nothing was learned. Whole texts count, however long. Rows without id are not held out. Other columns are not read."""
    held = F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))
    shared = docs.sparkSession.sparkContext.broadcast((model["prior"], model["table"]))
    return docs.select(F.col(key).cast("long").alias("doc_id"), held.alias("held_out"), plain(F.col(text)).alias("text")).mapInArrow(
        _predicted(shared, model["langs"]), "doc_id long, held_out boolean, lang_pred string, score double")
