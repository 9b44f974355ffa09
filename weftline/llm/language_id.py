"""Language identification by unigram models of pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability
is the sum over all ways to cut it into pieces (a forward algorithm over its characters), a text's
the product over its words. Piece probabilities come from expectation maximisation over the words
of a bounded sample of labelled rows: PER_LANGUAGE rows of each language, whole texts.

Scoring runs the forward algorithm for all new words of a block at once, one matrix for each word
length, following a span only while it begins some piece, and remembers a bounded number of words in each Python worker.
Chances are scaled by a constant for each character, words beyond LONGEST characters step by step, so that none becomes 0.

Defined cases: a text that is null or has no letter is `und` with score 0; without labelled rows
every text is; rows that repeat a doc_id are predicted each; a null doc_id is kept and never
trains; an empty table gives an empty result; other columns stay, and lang_pred and score replace those of the same
name. Texts and words of any length are scored whole; words beyond LONGEST characters don't train. A tie goes to the
language that comes first by code points.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Slots, blocks, mix, sample_by, stage, strings, table, tidy, words

PER_LANGUAGE = 1500
ROUNDS, LONGEST, UNKNOWN, REMEMBER = 3, 48, 1e-9, 400_000
#: Bytes of text that are scored, and go back to Spark, at once; a longer text is a block of its own.
BLOCK = 1 << 20
#: What chances are multiplied by for each character: an unknown character's is small, and LONGEST of them still more than 0.
SCALE = 1e3
MARK = "▁"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The vocabulary's pieces as hashes of their code points."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        lowered = {model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
        self.pieces = sorted(p for p in lowered if p)
        self.number = {p: i for i, p in enumerate(self.pieces)}
        self.longest = max(map(len, self.pieces))
        # What any piece begins with: by hash, and whether that is a piece itself.
        begun = sorted({p[:k] for p in self.pieces for k in range(1, len(p) + 1)})
        self.piece_of = np.array([self.number.get(p, -1) for p in begun])
        self.slots = Slots()
        self.slots.add(np.array([self._hash(p) for p in begun], np.uint64))

    @staticmethod
    def _hash(p: str) -> np.uint64:
        h = np.zeros(1, np.uint64)
        for c in p:
            h = Pieces.step(h, np.array([ord(c)], np.uint64))
        return h[0]

    @staticmethod
    def step(h: np.ndarray, c: np.ndarray) -> np.ndarray:
        return mix(h * np.uint64(0x9E3779B97F4A7C15) + c + np.uint64(1)) | np.uint64(1)

    def spans(self, points: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, words, their pieces there), by rising start; a single character that is no piece comes as -1."""
        n, length = points.shape
        for i in range(length):
            rows, h = np.arange(n), np.zeros(n, np.uint64)
            for j in range(i + 1, min(length, i + self.longest) + 1):
                h = self.step(h, points[rows, j - 1])
                begun = self.slots.find(h)
                go = begun >= 0
                found = np.where(go, self.piece_of[begun], -1)
                use = slice(None) if j == i + 1 else found >= 0
                yield i, j, rows[use], found[use]
                rows, h = rows[go], h[go]
                if not len(rows):
                    break


_pieces: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    if path not in _pieces:
        _pieces[path] = Pieces(path)
    return _pieces[path]


def _by_length(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indices, code points) of words of equal length, up to LONGEST with the mark before them."""
    parts: dict[int, tuple[list[int], list[str]]] = {}
    for k, w in enumerate(texts):
        w = MARK + w.lower()
        if len(w) <= LONGEST:
            at = parts.setdefault(len(w), ([], []))
            at[0].append(k)
            at[1].append(w)
    for length, (index, some) in sorted(parts.items()):
        yield np.array(index), np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, length).astype(np.uint64)


def forward(pieces: Pieces, points: np.ndarray, chances: np.ndarray) -> np.ndarray:
    """alpha[word, position, language], times SCALE for each character; chances: [piece, language], and a last row of zeros.
    One character that is no piece has the chance UNKNOWN."""
    alpha = np.zeros((len(points), points.shape[1] + 1, chances.shape[1]))
    alpha[:, 0] = 1
    for i, j, rows, found in pieces.spans(points):
        p = chances[found]
        if j == i + 1:
            p[found < 0] = UNKNOWN
        alpha[rows, j] += alpha[rows, i] * (p * SCALE ** (j - i))
    return alpha


def _long_word(pieces: Pieces, word: str, chances: np.ndarray) -> np.ndarray:
    """log chance of one word of any length: only the last sums are kept, scaled to their largest."""
    low, n = 0.0, pieces.longest
    last = [np.zeros(chances.shape[1])] * (n - 1) + [np.ones(chances.shape[1])]  # the sums of the n positions before
    for j in range(1, len(word) + 1):
        total = np.zeros(chances.shape[1])
        for k in range(1, min(n, j) + 1):
            at = pieces.number.get(word[j - k : j])
            if at is not None:
                total = total + last[-k] * chances[at]
            elif k == 1:
                total = total + last[-1] * UNKNOWN
        most = total.max()
        low += np.log(most)
        last = [x / most for x in last[1:]] + [total / most]
    return np.log(np.maximum(last[-1], 1e-300)) + low


def word_scores(pieces: Pieces, texts: list[str], chances: np.ndarray) -> np.ndarray:
    """log of each word's chance in each language, all segmentations summed."""
    out = np.zeros((len(texts), chances.shape[1]))
    for index, points in _by_length(texts):
        for a in range(0, len(index), 20_000):
            alpha = forward(pieces, points[a : a + 20_000], chances)
            out[index[a : a + 20_000]] = np.log(np.maximum(alpha[:, -1], 1e-300)) - points.shape[1] * np.log(SCALE)
    for k, w in enumerate(texts):
        if len(MARK + w.lower()) > LONGEST:
            out[k] = _long_word(pieces, MARK + w.lower(), chances)
    return out


def _expected(path: str, languages: list[str], chances: np.ndarray):
    """Forward and backward: how often each piece is expected in the words, by language."""

    def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = pieces_of(path)
        total = np.zeros((len(pieces.pieces), len(languages)))
        for batch in batches:
            number = batch["lang"].map(languages.index).to_numpy()
            times = batch["n"].to_numpy(float)
            for index, points in _by_length(batch["word"].tolist()):
                for a in range(0, len(index), 20_000):
                    _count(pieces, points[a : a + 20_000], chances, number[index[a : a + 20_000]], times[index[a : a + 20_000]], total)
        at = np.nonzero(total)
        yield pd.DataFrame({"piece": at[0].astype(np.int32), "lang": at[1].astype(np.int32), "n": total[at]})

    return expect


def _count(pieces: Pieces, points: np.ndarray, chances: np.ndarray, number: np.ndarray, times: np.ndarray, total: np.ndarray) -> None:
    own = np.append(chances, np.zeros((1, chances.shape[1])), axis=0)
    spans = []
    alpha = np.zeros((len(points), points.shape[1] + 1))
    alpha[:, 0] = 1
    for i, j, rows, found in pieces.spans(points):
        p = own[found, number[rows]]
        if j == i + 1:
            p[found < 0] = UNKNOWN
        p = p * SCALE ** (j - i)
        alpha[rows, j] += alpha[rows, i] * p
        spans.append((i, j, rows, found, p))
    beta = np.zeros_like(alpha)
    beta[:, -1] = 1
    for i, j, rows, _, p in reversed(spans):
        beta[rows, i] += p * beta[rows, j]
    norm = np.maximum(alpha[:, -1], 1e-300)
    for i, j, rows, found, p in spans:
        share = times[rows] * alpha[rows, i] * p * beta[rows, j] / norm[rows]
        good = (found >= 0) & (share > 0)
        np.add.at(total, (found[good], number[rows[good]]), share[good])


def held_out(modulus: int, remainder: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


class Model:
    def __init__(self, path: str, languages: list[str], chances: np.ndarray, prior: np.ndarray):
        self.path, self.languages, self.chances, self.prior = path, languages, chances, prior


def train(docs: DataFrame, path: str, per_language: int = PER_LANGUAGE, rounds: int = ROUNDS) -> Model:
    """docs: doc_id, text, lang, those to learn from."""
    spark = docs.sparkSession
    labelled = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    # per_language ids of each language: the bound of what is broadcast.
    chosen = sample_by(labelled.select("doc_id", "lang"), "lang", "doc_id", per_language).select(F.col("doc_id").alias("_id"))
    sample = labelled.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"), "left_semi")
    word = F.explode(F.split(F.lower("text"), "[\\x20\\x09-\\x0D]+")).alias("word")
    counts = stage(sample.select("lang", word).where("word <> ''").groupBy("lang", "word").agg(F.count("*").alias("n")), "language-words")
    languages = sorted((r["lang"] for r in counts.select("lang").distinct().toLocalIterator()), key=lambda s: [ord(c) for c in s])
    pieces = pieces_of(path)
    sizes = {r["lang"]: r["n"] for r in sample.groupBy("lang").agg(F.count("*").alias("n")).toLocalIterator()}
    prior = np.array([sizes.get(x, 1) for x in languages], float)
    chances = np.full((len(pieces.pieces), len(languages)), 1 / len(pieces.pieces))
    for _ in range(rounds if languages else 0):
        got = counts.mapInPandas(_expected(path, languages, chances), "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        n = np.full(chances.shape, 0.1)
        n[got["piece"], got["lang"]] += got["n"].round(6)
        chances = n / n.sum(axis=0)
    return Model(path, languages, np.append(chances, np.zeros((1, len(languages))), axis=0), np.log(prior / max(prior.sum(), 1)))


class _Scorer:
    """Log chances of words, remembered: one for each Python worker, and for one model at a time."""

    def __init__(self, model: Model):
        self.model, self.pieces = model, pieces_of(model.path)
        self.forget()

    @classmethod
    def of(cls, name: str, held) -> _Scorer:
        if name not in _scorers:
            _scorers.clear()
            _scorers[name] = cls(held.value)
        return _scorers[name]

    def forget(self) -> None:
        self.slots, self.scores = Slots(), np.zeros((1 << 12, len(self.model.languages)))

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The sum over each text's words."""
        hashes, starts, ends, first = words(data, offsets)
        hashes = hashes | np.uint64(1)
        which = self.slots.find(hashes)
        if (which < 0).any():
            new, at = np.unique(hashes[which < 0], return_index=True)
            at = np.flatnonzero(which < 0)[at]
            if self.slots.n + len(new) > REMEMBER:
                self.forget()
                new, at = np.unique(hashes, return_index=True)
            texts = [data[a:b].tobytes().decode(errors="replace") for a, b in zip(starts[at].tolist(), ends[at].tolist())]
            n = self.slots.n + len(new)
            if n > len(self.scores):
                self.scores = np.resize(self.scores, (2 * n, self.scores.shape[1]))
            self.scores[self.slots.n : n] = word_scores(self.pieces, texts, self.model.chances)
            self.slots.add(new)
            which = self.slots.find(hashes)
        sums = np.zeros((len(offsets) - 1, self.scores.shape[1]))
        full = np.flatnonzero(np.diff(first))
        if len(full):
            sums[full] = np.add.reduceat(self.scores[which], first[full], axis=0)
        return sums


_scorers: dict[str, _Scorer] = {}

_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def _lettered(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    seen = np.concatenate([[0], np.cumsum(_ASCII_LETTER[data])])[offsets]
    out = np.diff(seen) > 0
    for i in np.flatnonzero(~out & (np.diff(offsets) > 0)):
        out[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode(errors="replace"))
    return out


def _predictor(held, name: str):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer.of(name, held)
        for batch in batches:
            data, offsets = strings(batch["text"])
            for i, j in blocks(offsets, BLOCK):  # each goes out by itself, so that neither side holds a whole batch's results
                part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                names, best = ["und"] * (j - i), np.zeros(j - i)
                if scorer.model.languages:
                    lettered = _lettered(part, at)
                    total = scorer.score(part, at) + scorer.model.prior
                    top = total.argmax(axis=1)
                    chance = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                    names = [scorer.model.languages[t] if ok else "und" for t, ok in zip(top, lettered)]
                    best = np.where(lettered, chance, 0.0)
                some = batch.slice(i, j - i)
                yield pa.record_batch([some["doc_id"], some["text"], pa.array(names, pa.string()), pa.array(best, pa.float64()), some["rest"]], names=["doc_id", "text", "lang_pred", "score", "rest"])

    return tidy(predict)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs: doc_id, text and any others. Out: the same rows with lang_pred and score; a row's own lang isn't read.
    A row's text goes to Python and back once."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    others = [c for c in docs.columns if c not in ("doc_id", "lang_pred", "score")]
    rows = docs.select("doc_id", "text", F.struct(*[c for c in others if c != "text"], F.lit(0).alias("_")).alias("rest"))
    kind = rows.schema["rest"].dataType.simpleString()
    out = rows.mapInArrow(_predictor(held, uuid.uuid4().hex), f"doc_id long, text string, lang_pred string, score double, rest {kind}")
    return out.select("doc_id", "lang_pred", "score", *["text" if c == "text" else F.col(f"rest.{c}").alias(c) for c in others])


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out(4, 2))
    model = train(docs.where(~F.col("held_out")), default_vocabulary())
    return identify(docs.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score")


def in_fold(doc_id: int, modulus: int) -> int:
    """crc32(doc_id as text) mod modulus, for tests."""
    return zlib.crc32(str(doc_id).encode()) % modulus
