"""Packing: all token sequences are laid end to end and cut into windows of fixed length.

First pass: each input partition tokenizes its documents, keeps the ids, and sums up its tokens;
each document knows its start within its partition. The running sum over the partitions' totals
gives every document its global offset. Second pass: fixed windows are cut without any shuffle; a
window that crosses two partitions gets boundary records (pieces) from both.

Defined cases: a null or empty text is its end token alone; a null doc_id is kept; repeated rows
are packed each; an empty table gives no pieces. Only doc_id and text are read, whatever other columns are
called. A very long text is cut over many windows. Strings of added tokens get the ids that the library gives them. The last window
is padded to its full length, unless what it holds is a power of two (column padded_to).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, strings, table, tidy
from .tokens import bpe

WINDOW = 2048
END_ID = 1


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_TOKENIZED = "part int, doc_id long, local_start long, n_tokens long, ids binary"


def _tokenizer(vocabulary: str):
    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, start = bpe(vocabulary), 0
        for batch in batches:
            ids, before = model.encode(*strings(batch["text"]))
            sizes = np.diff(before)
            raw = ids.view(np.uint8)
            width = ids.itemsize
            ends = np.cumsum(sizes + 1)
            yield pa.record_batch(
                {
                    "part": batch["part"],
                    "doc_id": batch["doc_id"],
                    "local_start": pa.array(start + ends - sizes - 1),
                    "n_tokens": pa.array(sizes + 1),
                    "ids": pa.array([raw[a * width : b * width].tobytes() for a, b in zip(before[:-1], before[1:])], pa.binary()),
                }
            )
            start += int(ends[-1]) if len(ends) else 0

    return tokenize


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_to long"


def _cutter(window: int, end_id: int, width: int, total: int):
    rest = total % window
    tail = rest if rest and rest & (rest - 1) == 0 else window

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = f"<u{width}"
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for doc, at, n, ids in zip(*(batch[c].to_pylist() for c in ("doc_id", "global_start", "n_tokens", "ids"))):
                ids = np.append(np.frombuffer(ids, dtype), np.array(end_id, dtype)).astype("<u4")
                start = 0
                while start < n:
                    sequence, offset = divmod(at + start, window)
                    length = min(window - offset, n - start)
                    crc = zlib.crc32(ids[start : start + length].tobytes())
                    for column, value in zip(out, (doc, start, length, crc, n, sequence, offset, tail if (sequence + 1) * window > total else window)):
                        column.append(value)
                    start += length
            yield pa.record_batch([pa.array(c, pa.int64()) for c in out], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_to"])

    return cut


def tokenized(docs: DataFrame, vocabulary: str) -> DataFrame:
    """First pass. Kept as a table, so that the second pass sees the same partitions and ids."""
    rows = docs.select("doc_id", "text", F.spark_partition_id().alias("part"))
    return stage(rows.mapInArrow(tidy(_tokenizer(vocabulary)), _TOKENIZED), "tokens")


def pack(docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, vocabulary: str | None = None) -> DataFrame:
    """docs: doc_id, text. Out: a row for each piece."""
    vocabulary = vocabulary or default_vocabulary()
    spark = docs.sparkSession
    kept = tokenized(docs, vocabulary)
    # One number for each input partition: bounded by their number, whatever the input.
    totals = sorted((r["part"], r["n"]) for r in kept.groupBy("part").agg(F.sum("n_tokens").alias("n")).toLocalIterator())
    bases, total = [], 0
    for part, n in totals:
        bases.append((part, total))
        total += n
    starts = kept.join(F.broadcast(spark.createDataFrame(bases, "part int, base long")), "part")
    starts = starts.select("doc_id", (F.col("base") + F.col("local_start")).alias("global_start"), "n_tokens", "ids")
    from tokenizers import Tokenizer

    width = 2 if Tokenizer.from_file(vocabulary).get_vocab_size() <= 1 << 16 else 4
    return starts.mapInArrow(_cutter(window, end_id, width, total), _PIECES)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
