"""Mixing sources to target weights, by blocks of words.

The words of each source, document after document in the order of a hash, are cut into blocks of fixed length (a
two-pass prefix sum over the totals of ranges of that hash gives every document its place in its source; so the result
doesn't depend on how the rows are spread over files and tasks).
The mix is a row of output shards. Each shard draws from a multinomial how many of its slots each
source fills; the draws are without replacement from the slots that a source still has to fill,
so that the sums over all shards are exactly those that the targets ask for. The slots of a source
are numbered through all shards, and slot j of a source with n blocks holds block p(j mod n), where
p is a pseudorandom permutation of that source's blocks (a keyed Feistel network with cycle walking).
Slots and blocks are then joined by index. The last slot of a source may hold the beginning of a
block only, so that a source's words come to its rounded target.

Defined cases: sources in the order of their code points weigh by `weights` in turn, null last;
a text that is null or has no word has size 0 and is never taken; without any words all
targets are 0; rows that repeat a doc_id are mixed each; a null doc_id is kept; an empty table gives an empty result;
columns of any other names stay as they are; a very long text is cut over many blocks. Rows with equal hashes follow
doc_id and the hash of the text, and rows that are equal in these as well may change places. A document is
taken at most `most` times its size, as targets stop there and blocks repeat in whole rounds.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import mix, spread, stage, table, tidy

WEIGHTS, MOST, BLOCK, SHARD_SLOTS, PART_ROWS = (5, 2, 1), 3, 256, 100_000, 20_000
WORD = "[^\\x20\\x09-\\x0D]+"


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> dict[str | None, float]:
    """Each source's words in the mix: all sizes shared out by weight, at most `most` times a
    source's own size, and the excess shared out again among the others."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out: dict[str | None, float] = {}
    left, free = float(sum(sizes.values())), list(order)
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > most * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = float(most * sizes[s])
        left -= sum(out[s] for s in over)
        free = [s for s in free if s not in over]
    return out


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """p(index) for each index below n: a four-round Feistel network over the smallest even number
    of bits that holds n, walked until the result is below n."""
    n, key = n.astype(np.uint64), key.astype(np.uint64)
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2).astype(np.float64) + 1)).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = index.astype(np.uint64)
    left = np.arange(len(out))
    while len(left):
        x, h, m, k = out[left], half[left], mask[left], key[left]
        a, b = x >> h, x & m
        for turn in range(4):
            a, b = b, a ^ (mix(b + k + np.uint64(turn * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) & m)
        out[left] = (a << h) | b
        left = left[out[left] >= n[left]]
    return out.astype(np.int64)


def shard_counts(slots: dict[str | None, int], shard_slots: int, seed: int) -> Iterator[tuple[int, dict[str | None, tuple[int, int]]]]:
    """(shard, {source: (its first slot there, its slots there)}); counts are drawn without replacement."""
    names = list(slots)
    left = np.array([slots[s] for s in names], np.int64)
    first = np.zeros(len(names), np.int64)
    draw, shard = np.random.Generator(np.random.Philox(seed)), 0
    while total := int(left.sum()):
        got = left.copy() if total <= shard_slots else _without_replacement(draw, left, shard_slots)
        yield shard, {s: (int(f), int(g)) for s, f, g in zip(names, first, got) if g}
        first, left, shard = first + got, left - got, shard + 1


def _without_replacement(draw: np.random.Generator, left: np.ndarray, n: int) -> np.ndarray:
    """A multinomial draw of n; what it asks of a source beyond its rest is drawn again from the others."""
    got = np.zeros_like(left)
    while n:
        rest = left - got
        more = np.minimum(draw.multinomial(n, rest / rest.sum()), rest)
        got += more
        n -= int(more.sum())
    return got


_SLOTS = "source string, no_source boolean, block long, whole long, part long"


def _mapper(block: int, numbers: dict, seed: int):
    """Slots of a shard and source -> blocks by index: how often each is held whole, and to which length in part."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                number, n, size, target = numbers[row["source"]]
                for a in range(row["first"], row["first"] + row["n"], 1 << 16):
                    slot = np.arange(a, min(a + (1 << 16), row["first"] + row["n"]), dtype=np.int64)
                    at = slot % n
                    key = np.full(len(slot), mix(np.array([seed * 1_000_003 + number + 1], np.uint64))[0])
                    blocks = permuted(at, np.full(len(slot), n), key)
                    short = int(size - (n - 1) * block)  # the last block's length
                    length = np.where(blocks == n - 1, short, block)
                    # Words before this slot: whole rounds, then blocks, one of which may be the short one.
                    last = _position(n, key[0], n - 1)
                    before = (slot // n) * size + at * block - np.where(at > last, block - short, 0)
                    take = np.clip(target - before, 0, length)
                    yield pa.record_batch(
                        [pa.array([row["source"]] * len(slot), pa.string()), pa.array([row["source"] is None] * len(slot)), pa.array(blocks), pa.array((take == length).astype(np.int64)), pa.array(np.where(take == length, 0, take))],
                        names=["source", "no_source", "block", "whole", "part"],
                    )

    return held


_found: dict[tuple[int, int], int] = {}


def _position(n: int, key, block: int) -> int:
    """The index that p maps to block: the network backwards, walked likewise."""
    if (n, int(key)) not in _found:
        half = max(1, (math.ceil(math.log2(max(n, 2) + 1)) + 1) // 2)
        mask, x = (1 << half) - 1, block
        while True:
            a, b = x >> half, x & mask
            for turn in reversed(range(4)):
                f = int(mix(np.array([(a + int(key) + turn * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF], np.uint64))[0]) & mask
                a, b = b ^ f, a
            x = (a << half) | b
            if x < n:
                break
        _found[(n, int(key))] = x
    return _found[(n, int(key))]


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = 1, row_id: str | None = None) -> DataFrame:
    """docs: doc_id, source, text, and in the column `row_id`, where one is named, a number of its own for each row. Out, for each row: doc_id, source, row_id, size, source_size, target,
    taken, and segments: how often the mix takes which ranges of its words (start, length, times)."""
    spark = docs.sparkSession
    # What the order of words goes by: nothing of it depends on where a row is stored.
    key, text_key = F.xxhash64("doc_id", F.lit(seed)), F.xxhash64("text")
    rows = stage(docs.select("doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"), (F.col(row_id) if row_id else F.monotonically_increasing_id()).alias("row_id"), key.alias("key"), text_key.alias("text_key")), "sizes")
    rows = rows.withColumn("part", F.pmod("key", F.lit(spread(rows.count(), PART_ROWS))))
    by_part = stage(rows.groupBy("part", "source").agg(F.sum("size").alias("n")), "part-sizes")
    # The driver holds a few numbers for each source, whatever their documents.
    sizes: dict[str | None, int] = {r["source"]: r["n"] for r in by_part.groupBy("source").agg(F.sum("n").alias("n")).toLocalIterator()}
    wanted = targets(sizes, weights, most)
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    numbers, slots = {}, {}
    for i, s in enumerate(order):
        n, target = math.ceil(sizes[s] / block), round(wanted[s])
        numbers[s] = (i, n, sizes[s], target)
        whole, rest = divmod(target, sizes[s]) if sizes[s] else (0, 0)
        slots[s] = whole * n + min(n, math.ceil(rest / block) + 1) * (rest > 0)
    drawn = [(shard, s, first, n) for shard, by in shard_counts(slots, shard_slots, seed) for s, (first, n) in by.items()]
    plan = spark.createDataFrame(drawn, "shard int, source string, first long, n long").repartition(max(1, min(len(drawn), 4096)))
    held = plan.mapInArrow(_mapper(block, numbers, seed), _SLOTS)
    # As a table: the planner would take the slots' size for that of the plan they come from, and broadcast them.
    held = stage(held.groupBy("source", "no_source", "block").agg(F.sum("whole").alias("whole"), F.max("part").alias("part")), "slots")

    # Each document's first word in its source: the base of its range and a running sum within the range.
    places = rows.groupBy("part").applyInArrow(_places, "doc_id long, source string, row_id long, size long, part long, local long")
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_part.select(F.col("part").alias("_part"), F.col("source").alias("_source"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    places = places.join(bases, (F.col("part") == F.col("_part")) & F.col("source").eqNullSafe(F.col("_source")))
    known = spark.createDataFrame([(s, sizes[s], float(wanted[s])) for s in sizes], "_name string, source_size long, target double")
    places = places.join(F.broadcast(known), F.col("source").eqNullSafe(F.col("_name")))
    places = stage(places.select("doc_id", "source", "row_id", "size", "source_size", "target", (F.col("base") + F.col("local")).alias("at")), "places")
    pieces = places.where("size > 0").select(
        "row_id", "at", F.col("size").alias("n"), "source", F.col("source").isNull().alias("no_source"),
        F.explode(F.expr(f"sequence(at div {block}, (at + size - 1) div {block})")).alias("block"),
    )
    pieces = pieces.withColumns({"low": F.greatest(F.col("at"), F.col("block") * block), "high": F.least(F.col("at") + F.col("n"), (F.col("block") + 1) * block)})
    pieces, held = pieces.alias("p"), held.alias("h")
    same = F.col("p.source").eqNullSafe(F.col("h.source")) & (F.col("p.block") == F.col("h.block"))
    joined = pieces.join(held, same).select("row_id", "at", "low", "high", "whole", (F.col("p.block") * block + F.col("part")).alias("end"))
    partly = F.greatest(F.lit(0), F.least(F.col("high"), F.col("end")) - F.col("low"))
    segment = F.struct((F.col("low") - F.col("at")).alias("start"), (F.col("high") - F.col("low")).alias("length"), F.col("whole").alias("times"), partly.alias("partly"))
    taken = joined.groupBy("row_id").agg(F.sum((F.col("high") - F.col("low")) * F.col("whole") + partly).alias("taken"), F.sort_array(F.collect_list(segment)).alias("segments"))
    taken = taken.withColumnRenamed("row_id", "_row")
    return places.join(taken, F.col("row_id") == F.col("_row"), "left").select("doc_id", "source", "row_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "segments")


def _places(rows: pa.Table) -> pa.Table:
    """The rows of one range: the words of the same source before each."""
    rows = rows.sort_by([("key", "ascending"), ("doc_id", "ascending"), ("text_key", "ascending"), ("size", "ascending")])
    code = rows["source"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    size = rows["size"].to_numpy()
    order = np.argsort(code, kind="stable")
    sums = np.cumsum(size[order]) - size[order]
    firsts = np.flatnonzero(np.diff(code[order], prepend=-1))
    sums -= np.repeat(sums[firsts], np.diff(np.append(firsts, len(code))))
    local = np.empty(len(code), np.int64)
    local[order] = sums
    return rows.select(["doc_id", "source", "row_id", "size", "part"]).append_column("local", pa.array(local))


def mixed_text(text: str, segments: list[dict]) -> str:
    """The words that the mix takes: one copy for each time, as they stand in the text, copies on lines of their own."""
    spans = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    copies = []
    for turn in range(max(s["times"] for s in segments) + 1):
        runs: list[list[int]] = []
        for s in segments:
            n = s["length"] if turn < s["times"] else s["partly"] if turn == s["times"] else 0
            if n and runs and runs[-1][1] == s["start"]:
                runs[-1][1] = s["start"] + n
            elif n:
                runs.append([s["start"], s["start"] + n])
        if runs == [[0, len(spans)]]:
            copies.append(text)
        elif runs:
            copies.append("\n".join(text[spans[a][0] : spans[b - 1][1]] for a, b in runs))
    return "\n".join(copies)


def mix_texts(docs: DataFrame, **options) -> DataFrame:
    """The rows that the mix takes, with the texts that it takes of them; a column n_chars follows."""
    columns = [c for c in docs.columns if c != "text"]
    numbered = stage(docs.select("doc_id", "source", "text", F.struct(*columns).alias("rest"), F.monotonically_increasing_id().alias("row")), "numbered")
    taken = mix_sources(numbered, row_id="row", **options).where("taken > 0").select(F.col("row_id").alias("row"), "segments")
    rows = numbered.select("row", "text", "rest").join(taken, "row").select("text", "segments", "rest")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [mixed_text(t or "", s) for t, s in zip(batch["text"].to_pylist(), batch["segments"].to_pylist())]
            yield pa.record_batch([pa.array(texts, pa.string()), batch["rest"]], names=["text", "rest"])

    out = rows.mapInArrow(tidy(rewrite), f"text string, rest {rows.schema['rest'].dataType.simpleString()}")
    length = F.length("text").cast("long")
    return out.select(*["text" if c == "text" else length.alias(c) if c == "n_chars" else F.col(f"rest.{c}").alias(c) for c in docs.columns])


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
