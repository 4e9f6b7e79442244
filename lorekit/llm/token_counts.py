"""Token counts by separator scan over flat, unindexed token files.

A token file is a stream of fixed-width ids with an end-of-document id after each document, and no index. It is read
in blocks of equal size that do not respect documents. Each block is searched for separators with one vectorised
comparison; a prefix scan over the blocks' summaries (block totals within stretches of ``STRETCH`` blocks, then over
the stretches) gives every block the number of documents before it and the open tokens it inherits."""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorekit.llm.textblocks import text_blocks
from lorekit.session import stage_path

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
EOD = 50256
BLOCK_TOKENS = 1 << 20
STRETCH = 4096
FILE_SCHEMA = "file int, block int, tokens binary, first_doc long, ids array<long>"


def token_dtype(eod: int):
    return np.uint16 if eod < 1 << 16 else np.uint32


def encoder(ranks_file: bytes):
    import tiktoken
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines()) if a}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def file_rows(ranks, eod: int, block_tokens: int):
    """A partition's documents as one file: blocks of exactly ``block_tokens`` ids (the last may be shorter), and the
    document ids in order as a separate column that the scan does not read."""
    names = ["file", "block", "tokens", "first_doc", "ids"]

    def f(batches):
        enc, file, block, docs = encoder(ranks.value), TaskContext.get().partitionId(), 0, 0
        held, size, ids = [], 0, []

        def row(tokens):
            nonlocal block, docs, ids
            out = pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([block], pa.int32()), pa.array([tokens.tobytes()]),
                                              pa.array([docs], pa.int64()), pa.array([ids], pa.list_(pa.int64()))], names)
            block, docs, ids = block + 1, docs + len(ids), []
            return out

        for batch in batches:
            for lo, offsets, _ in text_blocks(batch.column("text")):
                k = len(offsets) - 1
                for text in batch.column("text").slice(lo, k).to_pylist():
                    t = enc.encode_to_numpy(text or "", disallowed_special=())
                    held += [t.astype(token_dtype(eod)), np.array([eod], token_dtype(eod))]
                    size += len(t) + 1
                ids += batch.column("doc_id").slice(lo, k).to_pylist()
                if size >= block_tokens:
                    stream = np.concatenate(held)
                    for at in range(0, size - block_tokens + 1, block_tokens):
                        yield row(stream[at:at + block_tokens])
                    held = [stream[size - size % block_tokens:]]
                    size %= block_tokens
        if size or ids:
            yield row(np.concatenate(held))
    return f


def write_token_files(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER,
                      eod: int = EOD, block_tokens: int = BLOCK_TOKENS) -> None:
    """Encode every text (null as empty) into token files, one per input partition, as rows of blocks."""
    spark = docs.sparkSession
    with open(tokenizer, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows.mapInArrow(file_rows(ranks, eod, block_tokens), FILE_SCHEMA).write.option("compression", "zstd").parquet(path)


def flat_blocks(spark: SparkSession, path: str, eod: int = EOD, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, block, tokens) of raw little-endian token files at ``path``, read by Spark's binary source."""
    step = block_tokens * np.dtype(token_dtype(eod)).itemsize
    raw = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")
    at = F.explode(F.sequence(F.lit(0), F.greatest((F.length("content") - 1) / step, F.lit(0)).cast("int"))).alias("block")
    return raw.select("file", "content", at).select("file", "block", F.substring("content", F.col("block") * step + 1, F.lit(step)).alias("tokens"))


def scan_rows(eod: int, with_lengths: bool):
    def f(batches):
        for batch in batches:
            rows = []
            for b in batch.column("tokens"):
                t = np.frombuffer(b.as_buffer(), token_dtype(eod)) if b.is_valid else np.zeros(0, token_dtype(eod))
                ends = np.flatnonzero(t == eod)
                head, tail = (int(ends[0]), len(t) - int(ends[-1]) - 1) if len(ends) else (len(t), len(t))
                rows.append((len(t), len(ends), head, tail, (np.diff(ends) - 1).tolist() if with_lengths and len(ends) else []))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), *(pa.array(c, t) for c, t in zip(zip(*rows), types))]
                                             if rows else [batch.column("file"), batch.column("block"), *(pa.array([], t) for t in types)],
                                             ["file", "block", "size", "ends", "head", "tail", "inner"])
    return f


def token_counts(blocks: DataFrame, eod: int = EOD) -> DataFrame:
    """(file, ordinal, n_tokens, ended) per document of (file, block, tokens) rows.

    Blocks of a file are numbered from 0. A document's separator does not count. Tokens after a file's last
    separator are one more document that has not ended. Empty blocks and files without blocks add nothing."""
    kind = blocks.schema["file"].dataType.simpleString()
    found = blocks.select("file", "block", "tokens").mapInArrow(
        scan_rows(eod, True), f"file {kind}, block int, size long, ends long, head long, tail long, inner array<long>")
    found = found.withColumn("stretch", F.floor(F.col("block") / STRETCH))
    before = Window.partitionBy("file", "stretch").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # open: tokens since the last separator; blocks without one add all theirs to what they inherit
    start = F.coalesce(F.sum("size").over(before), F.lit(0))
    found = found.withColumn("at", start)
    cut = F.when(F.col("ends") > 0, F.col("at") + F.col("size") - F.col("tail"))
    local = found.withColumn("docs", F.coalesce(F.sum("ends").over(before), F.lit(0))).withColumn("cut", F.max(cut).over(before))
    whole = (found.groupBy("file", "stretch").agg(F.sum("size").alias("s_size"), F.sum("ends").alias("s_ends"), F.max(cut).alias("s_cut"),
                                                  F.max("block").alias("s_last")))
    earlier = Window.partitionBy("file").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.withColumn("s_at", F.coalesce(F.sum("s_size").over(earlier), F.lit(0)))
    whole = (whole.withColumn("s_open", F.col("s_at") - F.coalesce(F.max(F.col("s_at") + F.col("s_cut")).over(earlier), F.lit(0)))
             .withColumn("s_docs", F.coalesce(F.sum("s_ends").over(earlier), F.lit(0)))
             .withColumn("f_last", F.max("s_last").over(Window.partitionBy("file"))))
    d = local.join(whole.select(F.col("file").alias("f"), F.col("stretch").alias("s"), "s_open", "s_docs", "f_last"),
                   (F.col("file") == F.col("f")) & (F.col("stretch") == F.col("s")))
    opened = F.when(F.col("cut").isNull(), F.col("s_open") + F.col("at")).otherwise(F.col("at") - F.col("cut"))
    lengths = F.when(F.col("ends") > 0, F.concat(F.array(opened + F.col("head")), "inner")).otherwise(F.expr("CAST(array() AS array<long>)"))
    rest = F.when(F.col("ends") > 0, F.col("tail")).otherwise(opened + F.col("size"))
    open_end = (F.col("block") == F.col("f_last")) & (rest > 0)
    lengths = F.when(open_end, F.concat(lengths, F.array(rest))).otherwise(lengths)
    d = d.select("file", (F.col("docs") + F.col("s_docs")).alias("first"), "ends", F.posexplode(lengths).alias("nth", "n_tokens"))
    return d.select("file", (F.col("first") + F.col("nth")).alias("ordinal"), "n_tokens", (F.col("nth") < F.col("ends")).alias("ended"))


def document_token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, eod: int = EOD,
                          block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, n_tokens) per row of ``docs``: encoded to token files under the shared checkpoint folder, counted by
    the scan, and matched with the documents' order. Null and empty texts count 0; rows may share an id."""
    spark = docs.sparkSession
    path = stage_path(spark, "tokens")
    write_token_files(docs, path, key, text, tokenizer, eod, block_tokens)
    files = spark.read.parquet(path)
    names = files.select(F.col("file").alias("f"), "first_doc", F.posexplode("ids").alias("nth", "doc_id"))
    names = names.select("f", (F.col("first_doc") + F.col("nth")).alias("o"), "doc_id")
    counts = token_counts(files, eod)
    return counts.join(names, (F.col("file") == F.col("f")) & (F.col("ordinal") == F.col("o"))).select("doc_id", "n_tokens")
