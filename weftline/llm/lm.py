"""Language-model scores: a smoothed unigram base and a hashed maximum-entropy model.

The maximum-entropy model gives a token's class by a softmax over classes, from hashed features of what is
before it: the last word, the last two words, the classes of the last three, and, as a skip feature, those of
the three before. Within its class a token has its smoothed count. The most frequent tokens are
classes of their own; any other word belongs to the one of them that it stands near to most often, counted
with the inverse of their frequency (a fixed number of slots hold that, by hash), so that classes keep apart what is written
in other languages and manners; one more class has the rest.

1. Texts are kept as chunks: distinct word hashes, and for each word the number of its hash.
2. Counts of training tokens: chunks' counts are summed by hash. Tasks' votes for classes are summed by slot.
3. Training: weights begin as shares of the log ratios that the observed counts of feature and class give. Then, in each
   round, every task sums the gradient at the common weights over its training tokens of that round's chunks, the
   sums of all tasks are added block by block, and the driver takes one step, scaled by the observed counts.
   All rounds together see each training token once.
4. Chunks ask the owners of hash ranges for the counts of their distinct words, and score all their
   texts in NumPy batches. No table that grows with the corpus is broadcast.

Defined cases: a null or empty text is the end token alone; a null doc_id is scored and is in
training; rows that repeat a doc_id are scored each; other columns aren't read, whatever their names; without training texts
every count is 0 and N and V are 0; an empty table gives an empty result. Very long texts are chunks of their own.
Words are told apart by 64-bit hashes; ties among the most frequent words go to the smaller hash, ties of votes to
the more frequent word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binaries, blocks, mix, spread, stage, strings, table, tidy, words
from .language_id import held_out

CHUNK = 1 << 22
OWN, HASHED, FEATURES, ROUNDS = 15, 1 << 13, 4, 2
#: Tokens whose scores of all classes are held at once: they fit a core's cache.
BATCH = 1 << 13
CLASSES = 2 + 2 * OWN  # the end token, frequent words, words near to each of these, other words
#: Slots that remember which frequent word a word is near to, in how many blocks, and how far near is.
SLOTS, BLOCKS, NEAR = 1 << 20, 64, 3
#: The part of the log ratios that weights begin with, steps, and counts that are added when a step is scaled.
SHARE, RATE, DAMP = 0.35, 0.5, 30.0
PER_OWNER = 4_000_000
_START, _ODD = np.uint64(0x5851F42D4C957F2D), np.uint64(0x9E3779B97F4A7C15)

_ENCODED = "chunk long, docs binary, none binary, held binary, first binary, word binary, uniq binary, trained binary, n_trained long"


def _packed(numbers: np.ndarray) -> bytes:
    """32-bit numbers, byte planes one after the other, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _numbers(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    k = 0
    for batch in batches:
        data, offsets = strings(batch["text"])
        part = batch["part"].to_numpy()
        docs = batch["doc_id"].fill_null(0).to_numpy()
        none = batch["doc_id"].is_null().to_numpy(zero_copy_only=False)
        held = batch["held_out"].to_numpy(zero_copy_only=False)
        for i, j in blocks(offsets, CHUNK):
            hashes, _, _, first = words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            uniq, word, times = np.unique(hashes, return_inverse=True, return_counts=True)
            order = np.argsort(-times, kind="stable")  # frequent words get small numbers
            rank = np.empty(len(uniq), np.uint32)
            rank[order] = np.arange(len(uniq), dtype=np.uint32)
            uniq, word = uniq[order], rank[word]
            training = np.repeat(~held[i:j], np.diff(first))
            trained = np.bincount(word[training], minlength=len(uniq)).astype(np.uint32)
            row = [(int(part[0]) << 32) + k, docs[i:j].tobytes(), none[i:j].tobytes(), held[i:j].tobytes(), first.astype(np.int64).tobytes(), _packed(word), uniq.tobytes(), trained.tobytes(), int((~held[i:j]).sum())]
            k += 1
            kinds = [pa.int64(), *[pa.binary()] * 7, pa.int64()]
            yield pa.record_batch([pa.array([x], t) for x, t in zip(row, kinds)], names=[c.split()[0] for c in _ENCODED.split(", ")])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uniq, trained in zip(batch["uniq"].to_pylist(), batch["trained"].to_pylist()):
            n = np.frombuffer(trained, np.uint32)
            at = np.flatnonzero(n)
            yield pa.record_batch({"h": pa.array(np.frombuffer(uniq, np.int64)[at]), "c": pa.array(n[at].astype(np.int64))})


def _before(values: np.ndarray, first: np.ndarray, start, end, distances: tuple[int, ...]) -> list[np.ndarray]:
    """values: one for each word of all texts. For each token (words, and an end after each text) the values at these
    distances before it: `start` beyond the text's begin."""
    texts = len(first) - 1
    ends = first[1:] + np.arange(texts)
    flat = np.full(len(values) + texts, end, values.dtype)
    at = np.ones(len(flat), bool)
    at[ends] = False
    flat[at] = values
    begins = first[:-1] + np.arange(texts)
    place = np.arange(len(flat)) - np.repeat(begins, np.diff(first) + 1)
    out = []
    for d in distances:
        x = np.empty_like(flat)
        x[d:], x[:d] = flat[: max(0, len(flat) - d)], start
        x[place < d] = start
        out.append(x)
    return out


class Features:
    """Classes of words, and features of what is before them."""

    def __init__(self, top: np.ndarray, near: np.ndarray | None = None):
        """top: the frequent words' hashes; near: for each slot the number of the frequent word, OWN where there is none."""
        self.order = np.argsort(top)
        self.top = top[self.order]
        self.near = np.full(SLOTS, OWN, np.uint8) if near is None else near

    def own(self, uniq: np.ndarray) -> np.ndarray:
        """The number of each word among the frequent ones, or -1."""
        if not len(self.top):
            return np.full(len(uniq), -1)
        at = np.minimum(np.searchsorted(self.top, uniq), len(self.top) - 1)
        return np.where(self.top[at] == uniq, self.order[at], -1)

    def classes(self, uniq: np.ndarray) -> np.ndarray:
        own = self.own(uniq)
        return np.where(own >= 0, 1 + own, 1 + OWN + self.near[slots(uniq)].astype(np.int64))

    def of(self, hashes: np.ndarray, classes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The feature numbers of each token: all words of all texts, and an end after each text."""
        one, two = _before(hashes, first, _START, _START, (1, 2))
        c = [x.astype(np.uint64) + np.uint64(1) for x in _before(classes.astype(np.uint8), first, CLASSES, 0, (1, 2, 3, 4, 5, 6))]
        number = np.empty((len(one), FEATURES), np.int64)
        for k, h in enumerate((one, mix(one * _ODD + two), (c[0] << np.uint64(16)) + (c[1] << np.uint64(8)) + c[2], (c[3] << np.uint64(16)) + (c[4] << np.uint64(8)) + c[5])):
            number[:, k] = (mix(h * _ODD + np.uint64(k + 11)) % np.uint64(HASHED)).astype(np.int64) + k * HASHED
        return number

    def targets(self, classes: np.ndarray, word: np.ndarray, first: np.ndarray) -> np.ndarray:
        texts = len(first) - 1
        out = np.zeros(len(word) + texts, np.int64)
        at = np.ones(len(out), bool)
        at[first[1:] + np.arange(texts)] = False
        out[at] = classes[word]
        return out


def slots(uniq: np.ndarray) -> np.ndarray:
    return (mix(uniq ^ np.uint64(91)) % np.uint64(SLOTS)).astype(np.int64)


def log_softmax(weights: np.ndarray, number: np.ndarray) -> np.ndarray:
    z = weights[number[:, 0]]
    for k in range(1, number.shape[1]):
        z += weights[number[:, k]]
    z -= z.max(axis=1, keepdims=True)
    z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
    return z


def gradient(weights: np.ndarray, number: np.ndarray, target: np.ndarray, out: np.ndarray) -> None:
    """Adds to out what is observed of each feature and class, less what the weights expect."""
    for a in range(0, len(target), BATCH):
        some, t = number[a : a + BATCH], target[a : a + BATCH]
        g = log_softmax(weights, some)
        np.exp(g, out=g)
        np.negative(g, out=g)
        g[np.arange(len(t)), t] += 1
        for k in range(some.shape[1]):
            order = np.argsort((some[:, k] - k * HASHED).astype(np.uint16), kind="stable")  # sorted by radix
            rows = some[order, k]
            at = np.flatnonzero(np.diff(rows, prepend=-1))
            out[rows[at]] += np.add.reduceat(g[order], at, axis=0)


def _unpacked(row: dict) -> tuple[np.ndarray, ...]:
    return tuple(_numbers(row[c]) if c == "word" else np.frombuffer(row[c], t) for c, t in (("docs", np.int64), ("none", bool), ("held", bool), ("first", np.int64), ("word", None), ("uniq", np.uint64)))


_CHUNK = ("docs", "none", "held", "first", "word", "uniq")


def _blocks_of(arrays: np.ndarray) -> pa.RecordBatch:
    """A task's sums, in BLOCKS parts: half-precision numbers and what they are multiples of, compressed."""
    parts = []
    for p in np.array_split(arrays, BLOCKS):
        most = float(np.abs(p).max(initial=0)) or 1.0
        parts.append(np.float32(most).tobytes() + zstandard.ZstdCompressor(level=1).compress((p / most).astype("<f2").tobytes()))
    return pa.record_batch({"block": pa.array(np.arange(BLOCKS, dtype=np.int32)), "sums": pa.array(parts, pa.binary())})


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of blocks, as they come."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, blob in zip(batch["block"].to_pylist(), batch["sums"].to_pylist()):
            x = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[4:]), "<f2").astype(np.float64) * float(np.frombuffer(blob[:4], "<f4")[0])
            total[block] = total[block] + x if block in total else x
    yield pa.record_batch({"block": pa.array(list(total), pa.int32()), "sums": pa.array([x.astype(np.float32).tobytes() for x in total.values()], pa.binary())})


def _total(encoded: DataFrame, run, shape: tuple[int, ...]) -> np.ndarray:
    """The sum over all tasks of the arrays of this shape that run makes of chunks; the driver gets one array of that size."""
    parts = encoded.select("chunk", *_CHUNK).mapInArrow(tidy(run), "block int, sums binary")
    got = {r["block"]: r["sums"] for r in parts.repartition(BLOCKS, "block").mapInArrow(_added, "block int, sums binary").collect()}
    if not got:
        return np.zeros(shape, np.float32)
    return np.concatenate([np.frombuffer(got[k], np.float32) for k in sorted(got)]).reshape(shape)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(len(batch)):
            yield batch.slice(i, 1).to_pylist()[0]


def _near(top: np.ndarray, weights: np.ndarray):
    """Votes of chunks' training words: [slot, frequent word that is near]."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        votes, features = None, Features(top)
        for row in _chunks(batches):
            _, _, out, first, word, uniq = _unpacked(row)
            votes = np.zeros((SLOTS, OWN), np.float32) if votes is None else votes
            own = features.own(uniq)[word]
            text = np.repeat(np.where(out, -1, np.arange(len(out))), np.diff(first))
            for d in range(1, NEAR + 1):
                same = (text[d:] == text[:-d]) & (text[d:] >= 0)
                for a, b in ((word[:-d], own[d:]), (word[d:], own[:-d])):
                    at = np.flatnonzero(same & (b >= 0))
                    cells, n = np.unique(a[at].astype(np.int64) * OWN + b[at], return_counts=True)
                    np.add.at(votes, (slots(uniq)[cells // OWN], cells % OWN), n * weights[cells % OWN])
        if votes is not None:
            yield _blocks_of(votes.reshape(-1))

    return vote


def _trainer(features: Features, held, turn: int, rounds: int):
    """The gradient at the weights over the chunks of one round; where there are no weights yet, the observed counts over all."""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for row in _chunks(batches):
            if held is not None and row["chunk"] % rounds != turn:
                continue
            _, _, out, first, word, uniq = _unpacked(row)
            classes = features.classes(uniq)
            number = features.of(uniq[word], classes[word], first)
            target = features.targets(classes, word, first)
            use = np.flatnonzero(np.repeat(~out, np.diff(first) + 1))
            total = np.zeros((FEATURES * HASHED, CLASSES), np.float32) if total is None else total
            if held is not None:
                gradient(held.value, number[use], target[use], total)
            else:
                for k in range(FEATURES):
                    total += np.bincount(number[use, k] * CLASSES + target[use], minlength=total.size).reshape(total.shape).astype(np.float32)
        if total is not None:
            yield _blocks_of(total.reshape(-1))

    return train


def train(encoded: DataFrame, features: Features, rounds: int = ROUNDS) -> np.ndarray:
    """Weights: [feature, class]."""
    spark, shape = encoded.sparkSession, (FEATURES * HASHED, CLASSES)
    seen = _total(encoded, _trainer(features, None, 0, rounds), shape).astype(np.float64)
    tokens = seen.sum() / FEATURES
    if not tokens:
        return np.zeros(shape, np.float32)
    share = seen[:HASHED].sum(axis=0) / tokens + 1e-9
    weights = SHARE * np.log((seen + 2 * share) / (seen.sum(axis=1, keepdims=True) + 2) / share) + np.log(share) / FEATURES
    for turn in range(rounds):
        held = spark.sparkContext.broadcast(weights.astype(np.float32))
        step = RATE * _total(encoded, _trainer(features, held, turn, rounds), shape) / (seen / rounds + DAMP)
        weights = weights + np.clip(step, -1, 1)
        held.unpersist()
    return weights.astype(np.float32)


def _owner(hashes: np.ndarray, owners: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(owners) >> np.uint64(32)).astype(np.int64)


def _asker(owners: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, uniq in zip(batch["chunk"].to_pylist(), binaries(batch["uniq"], np.uint64)):
                h = np.sort(uniq)
                who, first = np.unique(_owner(h, owners), return_index=True)
                cuts = [*first.tolist(), len(h)]
                yield pa.record_batch({"owner": pa.array(who), "chunk": pa.array([chunk] * len(who), pa.int64()), "h": pa.array([h[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())})

    return ask


def _answer(asked: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
    h = counts["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    h, c = h[order], counts["c"].to_numpy(np.int64)[order]
    out = []
    for blob in asked["h"]:
        want = np.frombuffer(blob, np.uint64)
        got = np.zeros(len(want), np.int64)
        if len(h) and len(want):
            at = np.minimum(np.searchsorted(h, want), len(h) - 1)
            same = h[at] == want
            got[same] = c[at[same]]
        out.append(bytes([8 if got.max(initial=0) >> 32 else 4]) + got.astype("<i8" if got.max(initial=0) >> 32 else "<u4").tobytes())
    return pd.DataFrame({"owner": asked["owner"], "chunk": asked["chunk"], "c": out})


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scorer(held, total: int, distinct: int, ends: int, sizes: np.ndarray):
    """held: weights and features; sizes: for each class, N and V of its training tokens."""

    def score(chunks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        (weights, features), out = held.value, []
        in_order = np.concatenate([np.zeros(0, np.int64)] + [np.frombuffer(x, "<i8" if x[0] == 8 else "<u4", offset=1).astype(np.int64) for x in answers.sort_values("owner")["c"]])
        for row in chunks.to_dict("records"):
            docs, none, held_, first, word, uniq = _unpacked(row)
            counts = np.empty(len(uniq), np.int64)
            counts[np.argsort(uniq)] = in_order  # answers follow the sorted hashes
            classes = features.classes(uniq)
            number, target = features.of(uniq[word], classes[word], first), features.targets(classes, word, first)
            texts = len(first) - 1
            c = np.full(len(target), ends, np.int64)
            at = np.ones(len(target), bool)
            at[first[1:] + np.arange(texts)] = False
            c[at] = counts[word]
            model = np.empty(len(target))
            for a in range(0, len(target), BATCH):
                t = target[a : a + BATCH]
                model[a : a + BATCH] = log_softmax(weights, number[a : a + BATCH])[np.arange(len(t)), t]
            model = model / np.log(10) + np.log10((c + 1) / (sizes[target].sum(axis=1) + 1))
            starts = first[:-1] + np.arange(texts)
            n = np.diff(first) + 1
            base = np.add.reduceat(np.log10((c + 1) / (total + distinct + 1)), starts)
            out.append(
                pd.DataFrame(
                    {"doc_id": pd.array(np.where(none, None, docs), "Int64"), "held_out": held_, "n_tokens": n, "n_known": np.add.reduceat((c > 0).astype(np.int64), starts), "train_tokens": total, "base_score": base, "score": np.add.reduceat(model, starts)}
                )
            )
        return pd.concat(out)

    return score


def _by_class(held):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, n, v = held.value, np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for batch in batches:
            k = features.classes(batch["h"].to_numpy().view(np.uint64))
            c = batch["c"].to_numpy()
            n += np.array([c[k == i].sum() for i in range(CLASSES)], np.int64)
            v += np.bincount(k, minlength=CLASSES)
        yield pa.record_batch({"class": pa.array(np.arange(CLASSES)), "n": pa.array(n), "v": pa.array(v)})

    return add


def fit(encoded: DataFrame, counts: DataFrame, ends: int, rounds: int = ROUNDS) -> tuple[np.ndarray, Features, np.ndarray]:
    """Weights, features, and for each class N and V of its training tokens. All of fixed size."""
    spark = encoded.sparkSession
    frequent = counts.orderBy(F.desc("c"), "h").limit(OWN).collect()
    top = np.array([r["h"] for r in frequent], np.int64).view(np.uint64)
    votes = _total(encoded, _near(top, np.array([1e6 / r["c"] for r in frequent] + [0.0] * (OWN - len(top)), np.float32)), (SLOTS, OWN))
    features = Features(top, np.where(votes.any(axis=1), votes.argmax(axis=1), OWN).astype(np.uint8))
    held = spark.sparkContext.broadcast(features)
    sizes = np.zeros((CLASSES, 2), np.int64)
    for r in counts.mapInArrow(_by_class(held), "class long, n long, v long").groupBy("class").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        sizes[r["class"]] = r["n"], r["v"]
    sizes[0] = ends, ends > 0
    return train(encoded, features, rounds), features, sizes


def score(docs: DataFrame, rounds: int = ROUNDS, per_owner: int = PER_OWNER) -> DataFrame:
    """docs: doc_id, text, held_out (false: the row is in training). Out: a row for each row."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", F.coalesce("held_out", F.lit(False)).alias("held_out"), F.spark_partition_id().cast("long").alias("part"))
    encoded = stage(rows.mapInArrow(tidy(_encode), _ENCODED), "encoded")
    counts = stage(encoded.select("uniq", "trained").mapInArrow(_counted, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "counts")
    sums = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    some = encoded.agg(F.sum("n_trained").alias("ends"), F.sum(F.length("uniq") / 8).alias("asked")).first()
    ends = some["ends"] or 0
    total, distinct = (sums["n"] or 0) + ends, sums["v"] + (ends > 0)
    weights, features, sizes = fit(encoded, counts, ends, rounds)
    held = spark.sparkContext.broadcast((weights, features))
    owners = spread(int((some["asked"] or 0) + sums["v"]), per_owner)
    asked = encoded.select("chunk", "uniq").mapInArrow(_asker(owners), "owner long, chunk long, h binary")
    owned = counts.withColumn("owner", F.shiftright(F.shiftrightunsigned("h", 32) * owners, 32))
    answers = asked.groupBy("owner").cogroup(owned.groupBy("owner")).applyInPandas(_answer, "owner long, chunk long, c binary")
    return encoded.drop("trained", "n_trained").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(_scorer(held, total, distinct, ends, sizes), _SCORES)


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents").select("doc_id", "text", held_out(7, 2).alias("held_out")))
