"""Line dedup: a sharded minimal perfect hash over the repeated line keys, probed by documents.

A line's key is the line without white space at its ends, A-Z lower-cased. First pass: each task
counts, for each key, the documents that hold it and the largest doc_id among them. Keys of
enough documents go to shards; each shard builds a minimal perfect hash (levels of bit arrays,
as BBHash does) that indexes arrays of fingerprints, counts and largest doc_ids. Second pass:
documents probe the arrays; no line is joined. The arrays are broadcast in rounds of bounded
size: where one round holds them all, documents are rewritten in that same pass, else the rounds
probe a table of line hashes and their marks are joined to the texts by row.

Defined cases: a null or empty text is one empty line; a null doc_id counts as the smallest;
each row counts as a document, also where rows repeat a doc_id; an empty table gives an empty
result. New columns replace those of the same name. Keys are told apart by 128 bits.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLANKS, mix, spread, stage, table

MIN_POINTS, MIN_DOCS = 20, 3
KEYS_PER_SHARD = 200_000
#: Bytes of arrays that one round broadcasts at most (and one shard more).
ROUND_BYTES = 64_000_000
_LEAST = -(1 << 63)
_FLUSH = 200_000


def line_key(line: bytes, least: int) -> bytes | None:
    """The key, or None where it has fewer than `least` code points."""
    key = line.strip(BLANKS)
    if len(key) < least or (len(key) < 4 * least and len(key.decode(errors="replace")) < least):
        return None
    return key.lower()


def key_hashes(text: str | None, least: int) -> list[tuple[int, int]]:
    """(line number, 128-bit hash) of the lines whose keys are long enough."""
    out = []
    for i, line in enumerate((text or "").encode(errors="replace").split(b"\n")):
        if (key := line_key(line, least)) is not None:
            out.append((i, xxhash.xxh3_128_intdigest(key)))
    return out


def _counter(least: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list[int]] = {}

        def flush() -> pa.RecordBatch:
            keys = np.array([(k >> 64, k & 0xFFFFFFFFFFFFFFFF) for k in seen], np.uint64).reshape(-1, 2).view(np.int64)
            values = np.array(list(seen.values()), np.int64).reshape(-1, 2)
            seen.clear()
            return pa.record_batch([pa.array(x) for x in (keys[:, 0].copy(), keys[:, 1].copy(), values[:, 0].copy(), values[:, 1].copy())], names=["h", "fp", "n", "top"])

        for batch in batches:
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                doc = _LEAST if doc is None else doc
                for k in {k for _, k in key_hashes(text, least)}:
                    if old := seen.get(k):
                        old[0] += 1
                        old[1] = max(old[1], doc)
                    else:
                        seen[k] = [1, doc]
                if len(seen) > _FLUSH:
                    yield flush()
        yield flush()

    return count


class PerfectHash:
    """Level by level, keys that are alone in their cell of a bit array of twice their number stay
    there; the others go on. A key's index is the number of set bits before its own."""

    def __init__(self, keys: np.ndarray):
        self.levels, base = [], 0
        for level in range(64):
            if not len(keys):
                break
            size = max(64, 2 * len(keys))
            cell = (mix(keys + np.uint64(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(cell, minlength=size)[cell] == 1
            bits = np.zeros((size + 63) // 64 * 64, np.uint8)
            bits[cell[alone]] = 1
            whole = np.packbits(bits, bitorder="little").view(np.uint64)
            ranks = base + np.concatenate([[0], np.cumsum(np.bitwise_count(whole))[:-1]]).astype(np.int64)
            self.levels.append((size, whole, ranks))
            base += int(alone.sum())
            keys = keys[~alone]
        assert not len(keys)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """A number for each key; for a key that wasn't there, -1 or that of another."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (size, whole, ranks) in enumerate(self.levels):
            cell = mix(keys[left] + np.uint64(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) % np.uint64(size)
            word, bit = (cell >> np.uint64(6)).astype(np.int64), cell & np.uint64(63)
            here = (whole[word] >> bit) & np.uint64(1) == 1
            before = np.bitwise_count(whole[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[here]] = (ranks[word] + before)[here]
            left = left[~here]
        return out


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    keys = rows["h"].to_numpy(np.int64).view(np.uint64)
    # Two keys that share 64 of their 128 bits can't both be indexed by them: the second goes to a list beside.
    _, first = np.unique(keys, return_index=True)
    beside = rows.drop(rows.index[first])
    rows, keys = rows.iloc[first], keys[first]
    found = PerfectHash(keys)
    order = np.argsort(found.index(keys))
    arrays = (found, rows["fp"].to_numpy(np.int64)[order], np.minimum(rows["n"].to_numpy(np.int64)[order], 0xFFFFFFFF).astype(np.uint32), rows["top"].to_numpy(np.int64)[order])
    extra = {(h & 0xFFFFFFFFFFFFFFFF, fp & 0xFFFFFFFFFFFFFFFF): top for h, fp, top in zip(beside["h"].tolist(), beside["fp"].tolist(), beside["top"].tolist())}
    blob = pickle.dumps((arrays, extra))
    return pd.DataFrame({"shard": [int(rows["shard"].iloc[0])], "size": [len(blob)], "blob": [blob]})


class Shards:
    """The arrays of some of all shards."""

    def __init__(self, blobs: dict[int, bytes], shards: int):
        self.shards, self.of = shards, {k: pickle.loads(b) for k, b in blobs.items()}

    def tops(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is in the arrays, and the largest doc_id that holds it."""
        found, top = np.zeros(len(high), bool), np.zeros(len(high), np.int64)
        shard = (high % np.uint64(self.shards)).astype(np.int64)
        for k, ((hashed, prints, _, tops), extra) in self.of.items():
            at = np.flatnonzero(shard == k)
            i = hashed.index(high[at])
            good = (i >= 0) & (prints[i].view(np.uint64) == low[at]) if len(prints) else np.zeros(len(at), bool)
            found[at[good]], top[at[good]] = True, tops[i[good]]
            if extra:
                for j in at[~good]:
                    if (t := extra.get((int(high[j]), int(low[j])))) is not None:
                        found[j], top[j] = True, t
        return found, top


_of_worker: dict[str, Shards] = {}


def _shards(held, stamp: str, shards: int) -> Shards:
    """One broadcast's arrays, unpacked once in each Python worker; stamp: its name (an object's id may come again)."""
    if stamp not in _of_worker:
        _of_worker.clear()
        _of_worker[stamp] = Shards(held.value, shards)
    return _of_worker[stamp]


def _marks(docs: list, texts: list, arrays: Shards, least: int) -> dict[int, list[int]]:
    """Row in the batch -> the numbers of its lines that go."""
    rows, lines, keys = [], [], []
    for r, text in enumerate(texts):
        for i, k in key_hashes(text, least):
            rows.append(r)
            lines.append(i)
            keys.append(k)
    high = np.fromiter((k >> 64 for k in keys), np.uint64, len(keys))
    low = np.fromiter((k & 0xFFFFFFFFFFFFFFFF for k in keys), np.uint64, len(keys))
    found, top = arrays.tops(high, low)
    own = np.fromiter((_LEAST if d is None else d for d in docs), np.int64, len(docs))
    out: dict[int, list[int]] = {}
    for j in np.flatnonzero(found & (top != own[rows] if len(rows) else found)).tolist():
        out.setdefault(rows[j], []).append(lines[j])
    return out


def _rewrite(batch: pa.RecordBatch, marks: dict[int, list[int]]) -> pa.RecordBatch:
    texts, n_lines, n_dropped = [], [], []
    for r, text in enumerate(batch["text"].to_pylist()):
        text = text or ""
        gone = marks.get(r, ())
        n_lines.append(text.count("\n") + 1)
        n_dropped.append(len(gone))
        if gone:
            drop = set(gone)
            text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in drop)
        texts.append(text)
    return pa.record_batch([batch["doc_id"], pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), batch["rest"]], names=["doc_id", "text", "n_lines", "n_dropped", "rest"])


def line_dedup(docs: DataFrame, min_points: int = MIN_POINTS, min_docs: int = MIN_DOCS, round_bytes: int = ROUND_BYTES, keys_per_shard: int = KEYS_PER_SHARD) -> DataFrame:
    """docs: doc_id, text and any others. Out: the same rows with the lines that stay, and n_lines, n_dropped."""
    spark = docs.sparkSession
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_lines", "n_dropped")]
    whole = docs.select("doc_id", "text", F.struct(*others, F.lit(0).alias("_")).alias("rest"))
    counted = docs.select("doc_id", "text").mapInArrow(_counter(min_points), "h long, fp long, n long, top long")
    keys = stage(counted.groupBy("h", "fp").agg(F.sum("n").alias("n"), F.max("top").alias("top")).where(F.col("n") >= min_docs), "line-keys")
    shards = spread(keys.count(), keys_per_shard)
    unsigned = F.expr(f"cast(cast(h as decimal(20,0)) + if(h < 0, 18446744073709551616BD, 0BD) as decimal(20,0)) % {shards}BD").cast("int")
    built = stage(keys.withColumn("shard", unsigned).groupBy("shard").applyInPandas(_build, "shard int, size long, blob binary"), "line-arrays")
    rounds, room = [[]], round_bytes
    for row in built.select("shard", "size").toLocalIterator():  # a row for each shard
        if rounds[-1] and room < row["size"]:
            rounds.append([])
            room = round_bytes
        rounds[-1].append(row["shard"])
        room -= row["size"]

    def held(some: list[int]):
        blobs = {r["shard"]: bytes(r["blob"]) for r in built.where(F.col("shard").isin(some)).select("shard", "blob").toLocalIterator()}
        return spark.sparkContext.broadcast(blobs), uuid.uuid4().hex

    schema = T.StructType([whole.schema["doc_id"], T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), whole.schema["rest"]])
    if len(rounds) == 1:
        arrays, stamp = held(rounds[0])

        def in_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield _rewrite(batch, _marks(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), _shards(arrays, stamp, shards), min_points))

        out = whole.mapInArrow(in_one, schema)
    else:
        whole = stage(whole.withColumn("row", F.monotonically_increasing_id()), "line-texts")
        marked = None
        for some in rounds:
            arrays, stamp = held(some)

            def in_turn(batches: Iterator[pa.RecordBatch], arrays=arrays, stamp=stamp) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    marks = _marks(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), _shards(arrays, stamp, shards), min_points)
                    ids = batch["row"].to_pylist()
                    yield pa.record_batch([pa.array([ids[r] for r in marks], pa.int64()), pa.array(list(marks.values()), pa.list_(pa.int32()))], names=["row", "gone"])

            found = stage(whole.select("doc_id", "text", "row").mapInArrow(in_turn, "row long, gone array<int>"), "line-marks")
            arrays.unpersist()
            marked = found if marked is None else marked.unionByName(found)
        marked = marked.groupBy("row").agg(F.flatten(F.collect_list("gone")).alias("gone"))

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield _rewrite(batch, {r: g for r, g in enumerate(batch["gone"].to_pylist()) if g})

        out = whole.join(marked, "row", "left").mapInArrow(apply, schema)
    return out.select("doc_id", "text", "n_lines", "n_dropped", *[F.col(f"rest.{c}").alias(c) for c in others])


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM d),
k AS (SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, count(DISTINCT doc_id) AS n, max(doc_id) AS top FROM k WHERE length(key) >= 20 GROUP BY key),
m AS (SELECT k.doc_id, k.i, k.line, c.key IS NOT NULL AND k.doc_id <> c.top AS gone
      FROM k LEFT JOIN c ON k.key = c.key AND c.n >= 3 AND length(k.key) >= 20)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
