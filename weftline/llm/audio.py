"""Media columns: chroma fingerprints of audio, and recordings that align.

A recording's spectrum is folded into 12 pitch classes for each frame; the frames are smoothed and
normalised. Filters, each the log ratio of two areas of that image (sums come from its integral
image), are quantised to two bits in Gray code; 16 filters make an integer for each frame.
Equal fingerprints are one class. Classes that share integers are aligned by the offsets that their shared integers, at each of their frames,
vote for: those with votes enough are tried from the most voted on, and the first that the part of differing
bits over the whole overlap confirms is taken.

Defined cases: audio that is null, isn't 16-bit PCM WAV or is too short has no fingerprint and aligns with
nothing; rows that repeat an id are members of a class each; a null id has a fingerprint, but is no class's
representative; an empty table gives an empty result; other columns aren't read. Long recordings are folded in blocks of
FRAMES_AT_ONCE frames. Of matches with equal errors the smaller id comes first.
"""

from __future__ import annotations

import io
import struct
import wave
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_unique, mix, ragged, spread, stage, table, tidy, workers

FRAME, HOP = 2048, 512
MOST_ERRORS, SHARED, OVERLAP = 0.2, 3, 8
#: Frames of asking fingerprints in one block, and votes that are held before they are summed.
BLOCK, AT_ONCE = 2_000_000, 4_000_000
FRAMES_AT_ONCE = 2048
#: Clips whose fingerprints go back to Spark at once.
CLIPS = 64
_LOW, _HIGH = 65.0, 2100.0
#: The filters by rule: (shape, first pitch class, height, width in frames).
FILTERS = tuple((k % 4, (5 * k) % 12 - ((5 * k) % 12 + 2 + k % 3 > 12) * (2 + k % 3), 2 + k % 3, 4 + 3 * (k % 4)) for k in range(16))
WIDTH = max(f[3] for f in FILTERS)
_GRAY = np.array([0, 1, 3, 2], np.uint32)


def to_wav(samples: np.ndarray, rate: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(rate)
        w.writeframes(np.clip(samples * 32000, -32768, 32767).astype("<i2").tobytes())
    return out.getvalue()


def from_wav(blob: bytes | None) -> tuple[np.ndarray, int]:
    """Mono samples and the rate; none where the bytes can't be read."""
    try:
        with wave.open(io.BytesIO(blob or b"")) as w:
            if w.getsampwidth() != 2:
                return np.zeros(0), 1
            x = np.frombuffer(w.readframes(w.getnframes()), "<i2").astype(np.float64) / 32768
            n = w.getnchannels()
            return x[: len(x) // n * n].reshape(-1, n).mean(axis=1), w.getframerate()
    except (wave.Error, EOFError, struct.error):
        return np.zeros(0), 1


def chroma(samples: np.ndarray, rate: int) -> np.ndarray:
    """[frame, pitch class], each frame of length 1."""
    if len(samples) < FRAME:
        return np.zeros((0, 12))
    hertz = np.fft.rfftfreq(FRAME, 1 / rate)
    use = np.flatnonzero((hertz >= _LOW) & (hertz <= min(_HIGH, rate / 2)))
    pitch = np.round(12 * np.log2(hertz[use] / 440)).astype(int) % 12
    fold = np.zeros((len(use), 12))
    fold[np.arange(len(use)), pitch] = 1
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    window, parts = np.hanning(FRAME), []
    for a in range(0, len(frames), FRAMES_AT_ONCE):
        spectrum = np.fft.rfft(frames[a : a + FRAMES_AT_ONCE] * window, axis=1)[:, use]
        parts.append((spectrum.real**2 + spectrum.imag**2) @ fold)
    image = np.concatenate(parts)
    kernel = np.array([0.25, 0.75, 1, 0.75, 0.25])
    image = np.stack([np.convolve(c, kernel, "same") for c in image.T], axis=1) if len(image) >= 5 else image
    norm = np.sqrt((image**2).sum(axis=1, keepdims=True))
    return np.where(norm > 1e-6, image / np.maximum(norm, 1e-12), 0)


def fingerprint(samples: np.ndarray, rate: int) -> np.ndarray:
    image = chroma(samples, rate)
    n = len(image) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    total = np.zeros((len(image) + 1, 13))
    total[1:, 1:] = image.cumsum(axis=0).cumsum(axis=1)
    at = np.arange(n)

    def area(x: np.ndarray, w: int, y: int, h: int) -> np.ndarray:
        return total[x + w, y + h] - total[x, y + h] - total[x + w, y] + total[x, y]

    out = np.zeros(n, np.uint32)
    for k, (shape, y, h, w) in enumerate(FILTERS):
        whole = area(at, w, y, h)
        if shape == 0:  # the later half against the earlier
            one = area(at + w // 2, w - w // 2, y, h)
        elif shape == 1:  # the upper part against the lower
            one = area(at, w, y + h // 2, h - h // 2)
        elif shape == 2:  # the middle of the time against its ends
            one = area(at + w // 4, w // 2, y, h)
        else:  # the pitch classes against all
            whole, one = area(at, w, 0, 12), whole
        ratio = np.log((one + 0.01) / (whole - one + 0.01))
        level = np.digitize(np.round(ratio, 6), (-0.8, 0.0, 0.8) if shape != 3 else (-3.0, -2.0, -1.2))
        out |= _GRAY[level] << np.uint32(2 * k)
    return out


def _printer(play: Callable[[object], bytes] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), CLIPS):
                some = batch.slice(a, CLIPS)
                # one clip at a time: a batch of them as Python objects would be the batch once more
                found = [fingerprint(*from_wav(play(x.as_py()) if play else x.as_py())) for x in some["audio"]]
                yield pa.record_batch({"id": some["id"], "n": pa.array([len(x) for x in found], pa.int64()), "print": pa.array([x.astype("<u4").tobytes() for x in found], pa.binary())})

    return tidy(run)


def fingerprints(clips: DataFrame, play: Callable[[object], bytes] | None = None) -> DataFrame:
    """clips: id, audio (WAV, or what play makes WAV of: such a recording never leaves the worker that reads it).
    Out: id, n, print (little-endian 32-bit integers)."""
    return clips.select("id", "audio").mapInArrow(_printer(play), "id long, n long, print binary")


def _bit_errors(x: np.ndarray, y: np.ndarray, offset: int) -> float:
    """The part of differing bits over the whole overlap at that offset; 1 where the overlap is too short."""
    a, b = max(0, offset), max(0, -offset)
    m = min(len(x) - a, len(y) - b)
    return float(np.bitwise_count(x[a : a + m] ^ y[b : b + m]).sum() / (32 * m)) if m >= min(OVERLAP, len(x), len(y)) and m > 0 else 1.0


def _frames(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The integers of fingerprints that lie one after the other, whose they are, and the frame that they are of."""
    sizes = np.array([len(x) // 4 for x in blobs], np.int64)
    owner = np.repeat(np.arange(len(blobs)), sizes)
    return np.frombuffer(b"".join(blobs), "<u4"), owner, ragged(np.zeros(len(blobs), np.int64), sizes)


def _index(reps: np.ndarray, blobs: list[bytes]) -> tuple:
    """The inverted lists of a block of fingerprints."""
    code, owner, at = _frames(blobs)
    order = np.argsort(code, kind="stable")
    return reps, blobs, code[order], owner[order].astype(np.int32), at[order].astype(np.int32)


def _votes(index: tuple, blob: bytes, rep: int, asks: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(q's place in the block, offset, shared integers at it: every frame votes), for the pairs of one fingerprint that it has to
    look at: where it asks itself, those with smaller ids alone, as its own block meets the others."""
    reps, _, codes, owner, at = index
    code, _, y = _frames([blob])
    low, high = np.searchsorted(codes, code), np.searchsorted(codes, code, "right")
    ends = np.cumsum(high - low)
    span = 1 << 32
    keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
    i = 0
    while i < len(code):  # some integers at a time, so that hot ones need no more memory
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + AT_ONCE, "right")))
        x = ragged(low[i:j], high[i:j] - low[i:j])
        shift = at[x].astype(np.int64) - np.repeat(y[i:j], high[i:j] - low[i:j])
        q = owner[x].astype(np.int64)
        use = reps[q] < rep if asks else reps[q] != rep
        key, n = np.unique(q[use] * span + (shift[use] + (span >> 1)), return_counts=True)
        keys, back = np.unique(np.concatenate([keys, key]), return_inverse=True)
        sums = np.bincount(back, np.concatenate([sums, n]), minlength=len(keys)).astype(np.int64)
        i = j
    good = sums >= SHARED
    return keys[good] // span, keys[good] % span - (span >> 1), sums[good]


def _aligner(held):
    """Fingerprints -> their matches with a block of asking ones, both ways where both ask. A fingerprint is whole
    in its row, so its votes are summed where it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        reps, blobs = index[:2]
        for batch in batches:
            out: list[tuple[int, int, int, float]] = []
            for rep, blob, asks in zip(batch["rep"].to_pylist(), batch["print"].to_pylist(), batch["asks"].to_pylist()):
                q, shift, n = _votes(index, blob, rep, asks)
                order = np.lexsort((-shift, np.abs(shift), -n, q))  # of each pair the offset with most votes first
                y, last = np.frombuffer(blob, "<u4"), -1
                for k, d in zip(q[order].tolist(), shift[order].tolist()):
                    if k == last:  # confirmed at an offset with more votes
                        continue
                    error = _bit_errors(np.frombuffer(blobs[k], "<u4"), y, d)
                    if error <= MOST_ERRORS:
                        last = k
                        out.append((int(reps[k]), rep, d, error))
                        if asks:
                            out.append((rep, int(reps[k]), -d, error))
            columns = list(zip(*out)) if out else [[]] * 4
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64()))], names=["q", "r", "shift", "error"])

    return run


def align(clips: DataFrame, every: int = 20, block: int = BLOCK, play: Callable[[object], bytes] | None = None) -> tuple[DataFrame, DataFrame]:
    """clips: id, audio (as fingerprints() takes them). Out: members (id, n, rep: the smallest id with that fingerprint), and matches
    between classes (q, r, shift, error), where q has a member whose id `every` divides.

    The asking classes go by in blocks of about `block` frames, whose inverted lists are broadcast (their size is
    bounded); all classes meet each block where they are, so that no pair is shuffled."""
    prints = stage(fingerprints(clips, play), "prints")
    key = F.sha2("print", 256)
    classes = prints.where("n > 0").groupBy(key.alias("key")).agg(F.min("id").alias("rep"), F.count("*").alias("w"), F.first("print").alias("print"), F.max(F.coalesce(F.col("id") % every == 0, F.lit(False))).alias("asks"))
    classes = stage(classes.where("rep is not null"), "audio-classes")
    spark, asking = clips.sparkSession, classes.where("asks")
    n = spread(asking.agg(F.sum(F.length("print") / 4).alias("n")).first()["n"] or 0, block)
    dealt = classes.select("rep", "print", "asks").repartition(workers(spark))
    found = []
    for i in range(n):
        mine = asking.select("rep", "print").where(F.pmod(F.xxhash64("rep"), F.lit(n)) == i).orderBy("rep").toArrow()
        held = spark.sparkContext.broadcast(_index(mine["rep"].to_numpy(), mine["print"].to_pylist()))
        found.append(stage(dealt.mapInArrow(tidy(_aligner(held)), "q long, r long, shift long, error double"), "matches"))
    members = join_unique(prints.select("id", "n", key.alias("key")), classes.select("key", "rep", "w"), ["key"], "w").select("id", "n", "rep")
    return members, reduce(DataFrame.union, found)


RATE, NOTE = 8000, 1024
#: Notes of a piece and of a recording of it, and values whose signs tell the piece.
PIECE, PLAYED, SIGNS = 64, 48, 12


def tune(semitones: np.ndarray) -> np.ndarray:
    phase = np.cumsum(np.repeat(220 * 2 ** (np.asarray(semitones, float) / 12), NOTE)) * 2 * np.pi / RATE
    return (np.sin(phase) + 0.5 * np.sin(2 * phase)) * 0.5


def performance(vector) -> np.ndarray:
    """A recording of a vector: stands in for audio, which the tables don't have. The signs of its first values name a piece (a
    fixed pseudorandom melody), the next value says where the recording of it begins, the others are its noise. So rows that share
    these signs are recordings of one piece, each an excerpt of its own."""
    v = np.nan_to_num(np.resize(np.asarray([0.0] if vector is None or not len(vector) else vector, float), 64))
    name = int(sum(1 << k for k in range(SIGNS) if v[k] > 0))
    notes = mix(np.arange(PIECE, dtype=np.uint64) + np.uint64(name * PIECE + 1)) % np.uint64(25)
    first = int(abs(v[SIGNS]) * 1000) % (PIECE - PLAYED + 1)
    out = tune(notes[first : first + PLAYED].astype(float) - 12)
    return out + 0.02 * np.resize(v[SIGNS + 1 :], len(out))


def recording(vector) -> bytes:
    return to_wav(performance(vector), RATE)


def recordings(vectors: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 64):
                some = batch.slice(a, 64)
                yield pa.record_batch([some["vec_id"], pa.array([recording(v) for v in some["embedding"].to_pylist()], pa.binary())], names=["id", "audio"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, "id long, audio binary")


def op6_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("audio"))
    members, matches = align(vectors, every=1, play=recording)  # a recording is some 400 times the size of its vector: it's played where it is read
    best = matches.groupBy("q").agg(F.count("*").alias("n_links"), F.min(F.struct("error", "r", "shift")).alias("b"), F.lit(1).alias("one"))
    best = best.select(F.col("q").alias("rep"), "n_links", F.col("b.r").alias("best_match"), F.col("b.shift").alias("best_shift"), F.col("b.error").alias("best_error"))
    sizes = members.groupBy("rep").agg(F.count("*").alias("w"))
    out = join_unique(members, best.join(sizes, "rep"), ["rep"], "w")
    return out.select(F.col("id").alias("vec_id"), F.col("n").alias("n_frames"), F.col("rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "best_match", "best_shift", "best_error")
