"""Toxicity by weak supervision.

Voters: lexicons of public insults (one voter for each language and kind), patterns (a person addressed with an insult, shouting, masked
letters), and many groups of features (words and their first 4, 5 and 6 bytes) that a bounded
sample of labelled rows ties to toxic texts (three quarters of the texts with such a feature are toxic, and
of all features tried, chance would make only FALSE_ALARMS look so). A generative label model (two classes, each voter with
its own rates of true and false alarms, fitted by expectation maximisation) gives every row of the
sample a posterior label; where two voters agree within a class more than chance, as their estimated
correlations tell, their votes count less. A linear (logistic) classifier is trained on
the posterior labels, and its offset is set on the labelled rows. Scoring reads each text once.

Bounds: SAMPLE labelled rows of each label train (documented, as the contract allows), FEATURES
features are kept; both are the same at every size of the corpus.

Defined cases: a text that is null or empty has no vote and gets the base score; without labelled
rows of both labels only the lexicon and the patterns decide; rows that repeat a doc_id are scored
each, and a doc_id with several labels is learned with the largest; a null doc_id is scored and
never learned from; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _LOWER, Slots, blocks, hash_words, mix, sample_by, stage, strings, table, tidy, words
from .language_id import held_out

SAMPLE, FEATURES, FALSE_ALARMS, PURE, GROUPS, LIMIT = 10_000, 4_000, 4.0, 0.75, 24, 0.7
#: A toxic text that is missed weighs as much as so many false alarms, where the offset is set.
MISSED = 3
PREFIXES = (4, 5, 6)
#: Common insults in four languages, by language and kind.
LEXICONS = {
    "en, mind": "idiot idiots idiotic stupid moron morons moronic imbecile imbeciles dumb dumbass cretin halfwit nitwit dimwit simpleton",
    "en, worth": "loser losers worthless pathetic useless clown clowns failure nobody coward cowards",
    "en, dirt": "scum trash garbage vermin filth filthy disgusting repulsive parasite parasites pig pigs rat rats",
    "en, vulgar": "bastard bastards bitch bitches asshole assholes dickhead prick jerk jerks wanker twat crap bullshit",
    "de, mind": "dummkopf trottel idiot idioten schwachkopf vollidiot blödmann depp deppen dumm blöd",
    "de, worth": "versager abschaum nichtsnutz pack gesindel dreckskerl drecksack arschloch mistkerl widerlich ekelhaft",
    "fr, mind": "imbécile imbéciles crétin crétins débile débiles abruti abrutis idiote stupide",
    "fr, worth": "connard connards salaud salope ordure racaille minable raté déchet dégoûtant",
    "es, mind": "imbécil imbéciles estúpido estúpida estúpidos idiota idiotas tonto tonta cretino",
    "es, worth": "basura escoria gilipollas cabrón cabrones inútil asqueroso asquerosa patético perdedor",
}
PATTERNS = (
    rb"(?i)\byou(?:'re| are)? (?:an? |such an? |all )?(?:idiot|moron|loser|clown|scum|trash|stupid|pathetic|worthless|disgusting)",
    rb"(?i)\b(?:shut up|get lost|drop dead|go to hell|hate you|kill yourself)\b",
    rb"\b[a-zA-Z]+[*@#$]{2,}[a-zA-Z]+\b",
    rb"(?:\b[A-Z]{3,}\b[ ,]+){4,}",
)
SPECIAL = len(LEXICONS) + len(PATTERNS)
_COMPILED = [re.compile(p) for p in PATTERNS]


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's features, once each, and before each text the number so far."""
    hashes, starts, ends, first = words(data, offsets)
    h, of = [hashes], [np.arange(len(starts))]
    state = np.zeros(len(starts), np.uint64)
    padded = np.append(data, np.zeros(max(PREFIXES), np.uint8))
    for k in range(max(PREFIXES)):
        state = mix(state * np.uint64(0x9E3779B97F4A7C15) + _LOWER[padded[starts + k]].astype(np.uint64) + np.uint64(1))
        if k + 1 in PREFIXES:
            long = np.flatnonzero(ends - starts > k)
            h.append(state[long] ^ np.uint64(k + 1))
            of.append(long)
    every, word = np.concatenate(h) | np.uint64(1), np.concatenate(of)
    text = np.searchsorted(first, word, "right") - 1
    order = np.lexsort((every, text))
    every, text = every[order], text[order]
    once = np.ones(len(every), bool)
    once[1:] = (every[1:] != every[:-1]) | (text[1:] != text[:-1])
    every, text = every[once], text[once]
    return every, np.searchsorted(text, np.arange(len(offsets)))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of each label that have a feature."""
    for batch in batches:
        data, offsets = strings(batch["text"])
        toxic = batch["toxic"].to_numpy(zero_copy_only=False).astype(np.int64)
        for i, j in blocks(offsets):
            h, first = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            label = np.repeat(toxic[i:j], np.diff(first))
            distinct, at = np.unique(h, return_inverse=True)
            bad = np.bincount(at, label, len(distinct)).astype(np.int64)
            yield pa.record_batch([pa.array(distinct.view(np.int64)), pa.array(bad), pa.array(np.bincount(at, minlength=len(distinct)).astype(np.int64) - bad)], names=["h", "bad", "good"])


class Voters:
    """Which features a text has, and what the voters say of it."""

    def __init__(self, mined: np.ndarray):
        self.mined = mined
        found = {}
        for k, some in enumerate(LEXICONS.values()):  # a word of several lexicons counts for the first
            for end in (b"", b".", b",", b"!", b"?", b";", b":"):
                for h in hash_words([w.encode() + end for w in some.split()]) | np.uint64(1):
                    found.setdefault(int(h), k)
        self.lexicon, self.voter = Slots(), np.array(list(found.values()))
        self.lexicon.add(np.array(list(found), np.uint64))
        self.slots = Slots()
        self.slots.add(mined)
        self.group = (mix(mined ^ np.uint64(77)) % np.uint64(GROUPS)).astype(np.int64)
        self.n = GROUPS + SPECIAL

    def read(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """votes[text, voter]; and of the mined features that texts have: text and feature number."""
        h, first = features(data, offsets)
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        which = self.slots.find(h)
        votes = np.zeros((len(offsets) - 1, self.n), np.uint8)
        hit = which >= 0
        votes[text[hit], self.group[which[hit]]] = 1
        word = self.lexicon.find(h)
        votes[text[word >= 0], GROUPS + self.voter[word[word >= 0]]] = 1
        for k, p in enumerate(_COMPILED):
            for i in range(len(offsets) - 1):
                if p.search(data[offsets[i] : offsets[i + 1]].tobytes()):
                    votes[i, GROUPS + len(LEXICONS) + k] = 1
        return votes, text[hit], which[hit]


def label_model(votes: np.ndarray, base: float, rounds: int = 50) -> np.ndarray:
    """Posterior chance of the toxic class for each row of votes.

    Rates of each voter in either class by expectation maximisation from the votes alone; the
    votes' log ratios are divided by 1 plus the sum of a voter's positive correlations with others
    within the classes, so that voters who say the same thing count once."""
    n, m = votes.shape
    v = votes.astype(float)
    fired = v.sum(axis=1)
    post = np.where(fired > 0, 0.9, 0.02)
    damp = np.ones(m)
    for turn in range(rounds):
        on = [(v * w[:, None]).sum(axis=0) + s for w, s in ((post, 0.5), (1 - post, 0.05))]
        rate = [np.clip(o / (w.sum() + t), 1e-4, 1 - 1e-4) for o, w, t in zip(on, (post, 1 - post), (1.0, 1.0))]
        if turn == rounds // 2:
            cov = np.zeros((m, m))
            for w, r in ((post, rate[0]), (1 - post, rate[1])):
                d = v - r
                c = (d * w[:, None]).T @ d / max(w.sum(), 1)
                s = np.sqrt(np.maximum(np.diag(c), 1e-9))
                cov = np.maximum(cov, c / np.outer(s, s))
            np.fill_diagonal(cov, 0)
            damp = 1 + np.maximum(cov, 0).sum(axis=1)
        hit, miss = np.log(rate[0] / rate[1]), np.log((1 - rate[0]) / (1 - rate[1]))
        logit = np.log(base / (1 - base)) + v @ (np.maximum(hit, 0) / damp) + (1 - v) @ (np.minimum(miss, 0) / damp)
        post = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return post


def _linear(n: int, m: int, row: np.ndarray, column: np.ndarray, target: np.ndarray, rounds: int = 500) -> tuple[np.ndarray, float]:
    """Logistic regression of soft targets on 0/1 features, by gradient steps with momentum; weighted so that both classes count alike."""
    w, b = np.zeros(m), 0.0
    share = np.clip(target.mean(), 1e-3, 1 - 1e-3)
    weight = np.where(target > 0.5, 0.5 / share, 0.5 / (1 - share)) / n
    step_w, step_b = np.zeros(m), 0.0
    for _ in range(rounds):
        z = np.bincount(row, w[column], n) + b
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * weight
        step_w = 0.9 * step_w + np.bincount(column, g[row], m) + 1e-4 * w
        step_b = 0.9 * step_b + g.sum()
        w, b = w - 4.0 * step_w, b - 4.0 * step_b
    return w, b


class Model:
    def __init__(self, mined: np.ndarray, weights: np.ndarray, offset: float):
        self.mined, self.weights, self.offset = mined, weights, offset
        self.voters = Voters(mined)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        votes, text, which = self.voters.read(data, offsets)
        m = len(self.mined)
        z = np.bincount(text, self.weights[which], len(votes)) + votes[:, GROUPS:] @ self.weights[m:] + self.offset
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _sampled(rows: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """doc_id, text, toxic of up to `sample` rows of each label, chosen by a hash of doc_id."""
    labels = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    labels = labels.join(rows.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = sample_by(labels, "toxic", "doc_id", sample).select("doc_id", "toxic")
    return rows.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def train(rows: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """rows: doc_id, text of documents to learn from; labels: doc_id, toxic."""
    kept = stage(_sampled(rows, labels, sample), "toxic-sample")
    sizes = {r["toxic"]: r["n"] for r in kept.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    prior = (bad + 1) / (bad + good + 2)
    counted = kept.mapInArrow(_counts, "h long, bad long, good long").groupBy("h").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    # The likelihood ratio statistic of "as frequent in toxic texts as in others", for those that are more frequent.
    share, both = (bad + 0.5) / (bad + good + 1.0), F.col("bad") + F.col("good")
    surprise = lambda n, expected: F.when(n > 0, 2 * n * F.log(n / expected)).otherwise(0.0)
    evidence = surprise(F.col("bad"), both * share) + surprise(F.col("good"), both * (1 - share))
    counted = stage(counted.where(both >= 3), "toxic-counts")
    # Of n features without a tie, about n exp(-x / 2) have this evidence or more.
    least = 2 * math.log(max(1.0, counted.count() / FALSE_ALARMS))
    tied = counted.where((F.col("bad") >= PURE * both) & (F.col("bad") >= 3)).withColumn("evidence", F.round(evidence, 6)).where(F.col("evidence") >= least)
    top = tied.orderBy(F.desc("evidence"), "h").limit(FEATURES)
    mined = np.sort(np.array([r["h"] for r in top.select("h").collect()], np.int64).view(np.uint64))
    held = kept.sparkSession.sparkContext.broadcast(mined)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = Voters(held.value)
        for batch in batches:
            data, offsets = strings(batch["text"])
            votes, text, which = voters.read(data, offsets)
            cuts = np.searchsorted(text, np.arange(len(votes) + 1))
            seen = [np.unique(which[a:b]).astype(np.int32).tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.record_batch([batch["doc_id"], batch["toxic"], pa.array([x.tobytes() for x in votes], pa.binary()), pa.array(seen, pa.binary())], names=["doc_id", "toxic", "votes", "seen"])

    # At most twice `sample` rows of some bytes each.
    rows_ = kept.mapInArrow(read, "doc_id long, toxic int, votes binary, seen binary").toPandas().sort_values("doc_id", ignore_index=True)
    m, special = len(mined), SPECIAL
    if not len(rows_) or not bad or not good:
        return Model(mined, np.concatenate([np.zeros(m), [4.0] * len(LEXICONS), [4.0, 1.0, 1.0, 0.0]]), -3.0)
    votes = np.stack([np.frombuffer(x, np.uint8) for x in rows_["votes"]])
    post = label_model(votes, prior)
    seen = [np.frombuffer(x, np.int32) for x in rows_["seen"]]
    extra = np.argwhere(votes[:, GROUPS:])
    row = np.concatenate([np.repeat(np.arange(len(seen)), [len(s) for s in seen]), extra[:, 0]])
    column = np.concatenate([*seen, m + extra[:, 1]]).astype(np.int64)
    w, b = _linear(len(votes), m + special, row, column, post)
    z = np.bincount(row, w[column], len(votes))
    return Model(mined, w, _offset(z, rows_["toxic"].to_numpy()))


def _offset(z: np.ndarray, toxic: np.ndarray) -> float:
    """The offset that puts LIMIT where the labels part best: in the middle of the widest gap that has the least errors, by weight."""
    order = np.argsort(z, kind="stable")
    z, toxic = z[order], toxic[order]
    errors = MISSED * np.concatenate([[0], np.cumsum(toxic)]) + np.concatenate([np.cumsum((1 - toxic)[::-1])[::-1], [0]])
    cuts = np.concatenate([[z[0] - 2], (z[1:] + z[:-1]) / 2, [z[-1] + 2]])
    gaps = np.concatenate([[0], np.diff(z), [0]])
    best = min(range(len(cuts)), key=lambda i: (errors[i] + (0 < i < len(z) and gaps[i] == 0) * 1e9, -gaps[i]))
    return float(np.log(LIMIT / (1 - LIMIT)) - cuts[best])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs: doc_id, text and any others. Out: the same rows with score and predicted."""
    held = docs.sparkSession.sparkContext.broadcast((model.mined, model.weights, model.offset))
    others = [c for c in docs.columns if c not in ("doc_id", "score", "predicted")]
    rows = docs.select("doc_id", "text", F.struct(*others, F.lit(0).alias("_")).alias("rest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*held.value)
        for batch in batches:
            data, offsets = strings(batch["text"])
            found = [model.score(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in blocks(offsets)]
            s = np.concatenate(found) if found else np.zeros(0)
            yield pa.record_batch([batch["doc_id"], pa.array(s), pa.array((s >= LIMIT).astype(np.int32)), batch["rest"]], names=["doc_id", "score", "predicted", "rest"])

    kind = rows.schema["rest"].dataType.simpleString()
    out = rows.mapInArrow(tidy(run), f"doc_id long, score double, predicted int, rest {kind}")
    return out.select("doc_id", "score", "predicted", *[F.col(f"rest.{c}").alias(c) for c in others])


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out(3, 1))
    model = train(docs.where(~F.col("held_out")), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return score(docs, model).select("doc_id", "held_out", "score", "predicted")
