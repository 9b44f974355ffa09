"""What the operators of this package share: staged tables, joins that bear hot keys,
and vectorised word hashing over Arrow string columns."""

from __future__ import annotations

import atexit
import ctypes
import math
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The bytes that the contracts call white space: \x20 and \x09-\x0D.
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
BLANK_CLASS = "[\\x20\\x09-\\x0D]"

_staged: list[tuple[SparkSession, str, str | None]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, a temporary one if all run in one process (tests);
    on a cluster that is an error, as executors would write to folders of their own."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="weftline-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: lineage ends there, and
    a lost executor costs no recomputation of what came before. Removed by release() or clear(), at the latest when Python ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weftline-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _staged.append((spark, path, None))
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def bucketed(df: DataFrame, key: str, name: str, dealt: bool = False) -> DataFrame:
    """Like stage(), dealt out by key once (unless df is that already): later joins by that key shuffle the other side alone."""
    spark, own = df.sparkSession, uuid.uuid4().hex
    path, n = f"{shared_dir(spark)}/weftline-{name}-{own}", workers(df.sparkSession)
    out = (df if dealt else df.repartition(n, key)).write.format("parquet").option("compression", "zstd").option("path", path)
    out.bucketBy(n, key).sortBy(key).saveAsTable(f"weftline_{own}")
    _staged.append((spark, path, f"weftline_{own}"))
    out = spark.table(f"weftline_{own}")
    out.staged_at = path
    return out


def staged() -> set[str]:
    """Where the staged tables are."""
    return {path for _, path, _ in _staged}


def release(*tables: DataFrame) -> None:
    """Removes staged tables that nothing reads any more."""
    clear({t.staged_at for t in tables})


@atexit.register
def clear(paths: set[str] | None = None) -> None:
    """Removes staged tables of this process, all or those in paths."""
    for entry in [x for x in _staged if paths is None or x[1] in paths]:
        _staged.remove(entry)
        spark, path, name = entry
        try:
            if name:
                spark.sql(f"DROP TABLE IF EXISTS {name}")
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended; its folder goes with it
            continue


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that gives freed memory back to the system when its task ends: Python workers
    live on, and what a stage needed at its peak would stay theirs through all later ones."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return wrapped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def workers(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_unique(left: DataFrame, right: DataFrame, keys: list[str], weight: str, at_most: int = 1000, small: int = 100_000) -> DataFrame:
    """Left outer join of left with right, which has each key once and in `weight` the number
    of left rows that hold it.

    Up to `small` rows of right are broadcast (the caller lowers that for wide rows). Beyond them, keys
    that hold more than one in `at_most` of all left rows are hot. There are fewer than
    `at_most` of these, so they are broadcast; their left rows are spread over all partitions.
    Null keys match nothing. No key may hold a name of the other side's columns but the keys.
    """
    size = right.agg(F.count("*").alias("n"), F.sum(weight).alias("total")).first()
    if size["n"] <= small:
        return left.join(F.broadcast(right), keys, "left").select(*left.columns, *[c for c in right.columns if c not in keys])
    least = max(1000, (size["total"] or 0) // at_most)
    values = [c for c in right.columns if c not in keys]
    hot = right.where(F.col(weight) > least).select(*keys, F.struct(*values).alias("_hot"))
    rest = right.where(F.col(weight) <= least).select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.struct(*values).alias("_rest"), F.lit(0).alias("_kx")
    ).hint("merge")
    out = left.join(F.broadcast(hot), keys, "left")
    spread = F.when(F.col("_hot").isNotNull(), F.lit(1) + F.floor(F.rand(7) * 1_000_000).cast("int")).otherwise(0)
    out = out.withColumn("_x", spread)
    on = [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)] + [F.col("_x") == F.col("_kx")]
    out = out.join(rest, on, "left").withColumn("_got", F.coalesce("_hot", "_rest"))
    return out.select(*left.columns, *[F.col(f"_got.{c}").alias(c) for c in values])


def sample_by(rows: DataFrame, group: str, key: str, k: int) -> DataFrame:
    """The k rows of each group whose key has the smallest hash (key breaks ties). A group of any size is thinned by that
    hash before it is ranked, to about 4 k rows, so that no task gets more."""
    hashed = F.xxhash64(key)
    sizes = rows.groupBy(group).agg(F.count("*").alias("_n"))  # a row for each group
    low = F.lit(-float(1 << 63)) + F.lit(float(1 << 64)) * F.least(F.lit(1.0), F.lit(4.0 * k + 200) / F.col("_n"))
    some = rows.join(F.broadcast(sizes), group).where(hashed.cast("double") <= low).drop("_n")
    order = Window.partitionBy(group).orderBy(hashed, key)
    return some.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= k).drop("_k")


# ---------------------------------------------------------------- word hashing

_BLANK = np.zeros(256, bool)
_BLANK[list(BLANKS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift); a bijection."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


#: A random odd number for each byte value, an odd base and its inverse modulo 2**64.
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        m = max(n, 1 << 20)
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            x = np.full(m, base, np.uint64)
            x[0] = 1
            _powers[key] = np.cumprod(x, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def binaries(column: pa.Array, dtype) -> list[np.ndarray]:
    """The values of a binary column without nulls as arrays that share its memory."""
    if not len(column):
        return []
    data, offsets = strings(column.cast(pa.large_binary()))
    whole = data.view(dtype) if len(data) % np.dtype(dtype).itemsize == 0 else np.frombuffer(data.tobytes(), dtype)
    cuts = (offsets // np.dtype(dtype).itemsize).tolist()
    return [whole[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def blocks(offsets: np.ndarray, most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `most` bytes each; a longer text is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words (runs of bytes that aren't white space, A-Z lower-cased) of texts that lie one
    after the other in data: 64-bit hashes, start and end of each word in data, and for each
    text, and once more at the end, the number of words before it."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64)
    full = ~_BLANK[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = True
    np.logical_not(full[:-1], out=before[1:])
    starts = np.flatnonzero(full & (before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1] = True
    np.logical_not(full[1:], out=after[:-1])
    ends = np.flatnonzero(full & (after | edge[1:])) + 1
    up, down = _power(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[data]] * up[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return hashes, starts, ends, np.searchsorted(starts, offsets)


def hash_words(texts: list[bytes]) -> np.ndarray:
    """The hashes that words() gives for these single words."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    hashes, _, _, first = words(np.frombuffer(b"".join(texts), np.uint8), offsets)
    assert len(hashes) == len(texts) and (np.diff(first) == 1).all()
    return hashes


def spread(total: int, each: int) -> int:
    """How many parts of about `each` there are in total, 1 at least."""
    return max(1, math.ceil(total / each))


class Slots:
    """Open-addressing table from non-zero 64-bit hashes to the numbers 0, 1, 2... in the order of insertion."""

    def __init__(self, bits: int = 16):
        self.n, self.keys, self.values = 0, np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, or -1."""
        mask = np.uint64(len(self.keys) - 1)
        at = (hashes & mask).astype(np.int64)
        got = self.keys[at]
        out = np.where(got == hashes, self.values[at], -1)
        left = np.flatnonzero((got != hashes) & (got != 0))
        while len(left):
            at = (at[left] + 1 if len(at) == len(hashes) else at + 1) & int(mask)
            got, want = self.keys[at], hashes[left]
            same = got == want
            out[left[same]] = self.values[at[same]]
            more = ~same & (got != 0)
            left, at = left[more], at[more]
        return out

    def add(self, hashes: np.ndarray) -> None:
        """hashes: distinct ones that aren't in the table."""
        if 2 * (self.n + len(hashes)) > len(self.keys):
            old = self.keys[np.flatnonzero(self.keys)], self.values[np.flatnonzero(self.keys)]
            bits = max(len(self.keys).bit_length(), (4 * (self.n + len(hashes))).bit_length())
            self.keys, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)
            self._put(*old)
        self._put(hashes, np.arange(self.n, self.n + len(hashes), dtype=np.int32))
        self.n += len(hashes)

    def _put(self, hashes: np.ndarray, values: np.ndarray) -> None:
        mask = len(self.keys) - 1
        at = (hashes & np.uint64(mask)).astype(np.int64)
        while len(hashes):
            free = self.keys[at] == 0
            self.keys[at[free]] = hashes[free]
            won = free & (self.keys[at] == hashes)
            self.values[at[won]] = values[won]
            left = ~won
            hashes, values, at = hashes[left], values[left], (at[left] + 1) & mask


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[i], starts[i] + 1, ... of lengths[i] elements each, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)
