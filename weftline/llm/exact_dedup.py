"""Exact deduplication by a Golomb-coded exchange of fingerprints.

Every input partition sends its sorted, distinct 64-bit text hashes to the owners of the hash
ranges, as Golomb-Rice coded gaps. An owner answers each partition with a bitmap that marks the
hashes that more than one row holds. Only texts with a marked hash are shuffled; they are
grouped by their bytes, so that two texts of one hash stay apart.

Defined cases: a null text is an empty one; an empty table gives an empty result; a null doc_id
takes part in its group, and stays only where the whole group has none; rows that repeat a
doc_id count one by one. Other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANK_CLASS, join_unique, spread, stage, table

#: Hashes for one owner, which holds them in memory at once.
HASHES_PER_OWNER = 1_000_000
#: Suspect ids up to this number are broadcast (8 bytes each); beyond it they are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def rice_encode(values: np.ndarray) -> bytes:
    """Golomb-Rice code of sorted, distinct unsigned 64-bit values: their gaps, the quotients in
    unary and the remainders in k bits. The first byte is k, then come 8 bytes of the count."""
    n = len(values)
    gaps = np.diff(values, prepend=np.uint64(0))
    mean = int(values[-1]) // n if n else 1
    k = max(0, min(63, mean.bit_length() - 1))
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.zeros(int(quotients.sum()) + n, np.uint8)
    if n:
        unary[np.cumsum(quotients + 1) - 1] = 1
    bits = ((gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return bytes([k]) + n.to_bytes(8, "little") + np.packbits(np.concatenate([unary, bits.ravel()])).tobytes()


def rice_decode(blob: bytes) -> np.ndarray:
    k, n = blob[0], int.from_bytes(blob[1:9], "little")
    if not n:
        return np.zeros(0, np.uint64)
    bits = np.unpackbits(np.frombuffer(blob, np.uint8, offset=9))
    ends = np.flatnonzero(bits)[:n]
    quotients = np.diff(ends, prepend=-1) - 1
    rest = bits[ends[-1] + 1 : ends[-1] + 1 + n * k].reshape(n, k).astype(np.uint64)
    gaps = (quotients.astype(np.uint64) << np.uint64(k)) | (rest << np.arange(k, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.cumsum(gaps, dtype=np.uint64)


def _owner(hashes: np.ndarray, owners: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(owners) >> np.uint64(32)).astype(np.int64)


def _encoder(owners: int):
    def encode(rows: pd.DataFrame) -> pd.DataFrame:
        hashes, counts = np.unique(rows["h"].to_numpy(np.int64).view(np.uint64), return_counts=True)
        cuts = np.searchsorted(_owner(hashes, owners), np.arange(owners + 1))
        out = [(int(rows["part"].iloc[0]), o, rice_encode(hashes[a:b]), np.packbits(counts[a:b] > 1).tobytes()) for o, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
        return pd.DataFrame(out, columns=["part", "owner", "blob", "twice"])

    return encode


def _answer(rows: pd.DataFrame) -> pd.DataFrame:
    """rows: what one owner has got. Out: for each partition, the bits of its hashes that are held twice."""
    lists = [rice_decode(x) for x in rows["blob"]]
    every = np.concatenate(lists)
    distinct, counts = np.unique(every, return_counts=True)
    local = np.concatenate([np.unpackbits(np.frombuffer(t, np.uint8))[: len(x)] for t, x in zip(rows["twice"], lists)]).astype(bool)
    marked = counts > 1
    marked[np.searchsorted(distinct, every[local])] = True
    bits = [np.packbits(marked[np.searchsorted(distinct, x)]).tobytes() for x in lists]
    return pd.DataFrame({"part": rows["part"], "owner": rows["owner"], "bits": bits})


def _suspects(rows: pd.DataFrame, bits: pd.DataFrame) -> pd.DataFrame:
    """rows: one partition's documents; bits: the owners' answers to it, which follow its sorted hashes."""
    raw = rows["h"].to_numpy(np.int64).view(np.uint64)
    hashes = np.unique(raw)
    owners = bits.sort_values("owner")
    flags = np.zeros(len(hashes), bool)
    owner_of = _owner(hashes, int(owners["owners"].iloc[0]))
    for o, b in zip(owners["owner"], owners["bits"]):
        at = np.flatnonzero(owner_of == o)
        flags[at] = np.unpackbits(np.frombuffer(b, np.uint8))[: len(at)].astype(bool)
    return rows.loc[flags[np.searchsorted(hashes, raw)], ["doc_id"]]


def normalised(c) -> F.Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), BLANK_CLASS + "+", " ")


def exact_dedup(docs: DataFrame, hashes_per_owner: int = HASHES_PER_OWNER, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """docs: doc_id, text. Out, for each row: doc_id, keep_id, group_size, kept, text_sha256."""
    texts = docs.select("doc_id", normalised(F.col("text")).alias("norm"))
    prints = stage(
        texts.select("doc_id", F.xxhash64("norm").alias("h"), F.sha2("norm", 256).alias("text_sha256"), F.spark_partition_id().alias("part")),
        "prints",
    )
    owners = spread(prints.count(), hashes_per_owner)
    small = prints.select("part", "doc_id", "h")
    sent = small.groupBy("part").applyInPandas(_encoder(owners), "part int, owner int, blob binary, twice binary")
    bits = sent.groupBy("owner").applyInPandas(_answer, "part int, owner int, bits binary")
    bits = bits.withColumn("owners", F.lit(owners))
    suspects = stage(small.groupBy("part").cogroup(bits.groupBy("part")).applyInPandas(_suspects, "doc_id long").distinct(), "suspects")
    ids = suspects.select(F.col("doc_id").alias("_id"))
    if suspects.count() <= broadcast_ids:
        ids = F.broadcast(ids)
    held = texts.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    # The bytes themselves are the key here; equal texts of one task are counted before the shuffle.
    groups = held.groupBy("norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = stage(groups.where("group_size > 1").select(F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size"), "groups")
    out = join_unique(prints.select("doc_id", "text_sha256"), groups, ["text_sha256"], "group_size")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""
