"""Secret scans: candidates by their shape, a random forest to remove false positives.

Candidates are runs of key characters in words that hold letters and digits, known key formats,
and the values of assignments to telling names. The forest reads a candidate's length, its
transitions between kinds of characters, the part of it that dictionary words cover, the path that
its document came from, and the words around it. It is trained on labelled findings; those that
come with this module are written by rule (labelled_findings), a caller can give its own.

Defined cases: a null or empty text has no finding; a null source is an empty path; rows that
repeat a doc_id are scanned each; an empty table gives an empty result. Findings don't carry the
secret itself but its SHA-256.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import blocks, strings, table, words

LEAST = 12
TREES, DEPTH, LEAF, LIMIT = 40, 8, 3, 0.5
#: Public formats of keys.
FORMATS = (
    ("aws_key", re.compile(rb"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b")),
    ("github_token", re.compile(rb"\bgh[pousr]_[A-Za-z0-9]{36,}\b")),
    ("slack_token", re.compile(rb"\bxox[abprs]-[A-Za-z0-9-]{10,}")),
    ("google_key", re.compile(rb"\bAIza[0-9A-Za-z_-]{35}")),
    ("stripe_key", re.compile(rb"\b[sr]k_(?:live|test)_[0-9A-Za-z]{16,}")),
    ("jwt", re.compile(rb"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
)
_RUN = re.compile(rb"[A-Za-z0-9+/_=-]{12,}")
_TELLING = re.compile(r"(?:pass(?:word|wd)?|secret|token|api[_-]?key|apikey|auth|credential|private|access[_-]?key|bearer|pwd)", re.I)
#: A telling name and what is assigned to it: between quotes, or up to white space. Looked ahead to, as a value may hold names too.
_ASSIGNED = re.compile(
    rb"(?:pass(?:word|wd)?|secret|token|api[_-]?key|auth|credential|private|access[_-]?key|bearer|pwd)[\w-]*+[\"']?[ \t]*[:=]+>?[ \t]*"
    rb"(?=\"((?:[^\"\\\r\n]|\\.)+)\"|'((?:[^'\\\r\n]|\\.)+)'|[\"']?([^\s\"'][^\s]*))",
    re.I,
)
_HARMLESS = re.compile(r"(?:example|sample|dummy|placeholder|test|fake|commit|sha1|sha256|md5|hash|uuid|checksum|revision|color|image|version|doi|isbn|phone|card|http)", re.I)
_PATHY = re.compile(r"(?:test|example|doc|sample|fixture|mock|vendor|spec)", re.I)
_VOWEL = re.compile(r"[aeiou]", re.I)
#: Frequent English word parts of four letters or more.
DICTIONARY = frozenset(
    "about above access account action address after again against agent algorithm alpha always amount analysis angle animal another answer apple application area array article author available average background "
    "balance base basic before begin below between block board body border bottom branch break bridge bring browser buffer build button cache call camera cancel case center chain change channel character chart check child "
    "choice class clear click client clock close cloud code color column command comment common company complete component config connection console const contact container content context control copy count country course "
    "create current custom data database date default delete delta design detail device dialog digest direct directory display document domain double down driver dummy dynamic edit editor element email empty enable engine entry error event "
    "every example exception export extension factory false field file filter final find first flag float folder font form format forward frame free from front full function future game general get global graph green group handler hash have "
    "head header height hello help hidden high history home host hour house icon image import index info init input inside instance integer interface internal item java join json just keyboard label language large last layer layout left length level "
    "library light like limit line link list load local location lock login logo long look loop machine main make manager map mark master match math matrix media member memory menu message meta method middle minute missing mock model "
    "module month more mouse move music name native network never next node none normal note number object offset only open option order other output overlay owner package page panel parent part party pass password path pattern people person phone "
    "place plain player please plugin point policy port position post power prefix press preview previous price primary print private process product profile program project property public pull push query queue quick random range rate read "
    "record region release remote remove render replace report request reset resource response rest result return right role root route rule sample save scale schema scope screen script scroll search second secret section select send series server "
    "service session shape share shell show side sign simple single site size slot small smart social sort sound source space special split stack standard start state static status step stop store stream string strong style submit super switch "
    "symbol sync system table target task team template temp term test text that their then there this thread time title today token tool total touch trace track tree trigger true type under union unit update upload upper user utility valid "
    "value variable vector version video view virtual visible wait watch water week weight welcome what when where which white width window with word work world write year your zero zone".split()
)


def _covered(text: str) -> float:
    """The part of the letters that dictionary words cover, longest words first from each place."""
    low, n, i = text.lower(), 0, 0
    while i < len(low):
        for k in range(min(12, len(low) - i), 3, -1):
            if low[i : i + k] in DICTIONARY:
                n += k
                i += k
                break
        else:
            i += 1
    return n / max(1, len(text))


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


NAMES = ("length", "digits", "upper", "transitions", "repeats", "steps", "distinct", "entropy", "vowels", "hex", "coverage", "telling", "harmless", "assigned", "quoted", "path_harmless", "format")


def features(value: str, before: str, after: str, path: str, known: bool) -> list[float]:
    n = len(value)
    kinds = [_kind(c) for c in value]
    counts = np.unique(list(value), return_counts=True)[1] / n
    near = f"{before[-60:]} {after[:30]}"
    codes = [ord(c) for c in value]
    return [
        float(n),
        kinds.count(0) / n,
        kinds.count(2) / n,
        sum(a != b for a, b in zip(kinds, kinds[1:])) / n,
        sum(a == b for a, b in zip(codes, codes[1:])) / n,
        sum(b - a == 1 for a, b in zip(codes, codes[1:])) / n,
        len(counts) / n,
        float(-(counts * np.log2(counts)).sum()),
        len(_VOWEL.findall(value)) / n,
        float(all(c in string.hexdigits for c in value)),
        _covered(value),
        float(bool(_TELLING.search(before[-40:]))),
        float(bool(_HARMLESS.search(near))),
        float(bool(re.search(r"[=:]\s*[\"']?$", before))),
        float(before[-1:] in "\"'" and before[-1:] != ""),
        float(bool(_PATHY.search(path))),
        float(known),
    ]


def labelled_findings(n: int = 3000, seed: int = 5) -> list[tuple[str, str, str, str, bool, bool]]:
    """(value, text before, text after, path, known format, whether it is a secret), by rule: random keys that
    are assigned to telling names against hashes, identifiers, names of constants, numbers and placeholders."""
    draw, out = random.Random(seed), []
    alphabets = (string.hexdigits[:16], string.ascii_letters + string.digits, string.ascii_uppercase + string.digits, string.ascii_letters + string.digits + "+/_-")
    some = sorted(DICTIONARY)
    for i in range(n):
        good = i % 2 == 0
        text = lambda k: "".join(draw.choice(a) for _ in range(k))
        a = draw.choice(alphabets)
        filler = " ".join(draw.choice(some) for _ in range(4))
        known = False
        if good and draw.random() < 0.3:  # passwords and phrases of any length
            value = "".join(draw.choice(string.ascii_letters + string.digits + "!&@$.#%^*?") for _ in range(draw.randint(6, 16)))
            if draw.random() < 0.4:
                value = "".join(draw.choice("bcdfghklmnprstvw") + draw.choice("aeiou") + draw.choice("lnrst") for _ in range(2)) + str(draw.randint(0, 9999)) + text(draw.randint(0, 3))
            elif draw.random() < 0.4:
                value = "-".join("".join(draw.choice("bcdfghklmnprstvw") + draw.choice("aeiou") + draw.choice("lnrst") for _ in range(2)) for _ in range(draw.randint(3, 5)))
            before = f"{filler} {draw.choice(('secret', 'password', 'pwd', 'passwd', 'credential'))}{draw.choice((' = ', '=', ': ', ':'))}{draw.choice(('', chr(34), chr(39)))}"
            path = draw.choice(("src/app.py", "config/prod.yml", "src3", ".env", "web", "src11"))
        elif good:
            value = text(draw.choice((16, 20, 24, 32, 32, 40, 40, 48, 64)))
            known = draw.random() < 0.2
            name = draw.choice(("token", "api_key", "secret", "password", "auth_token", "access_key", "apikey", "pwd", "credential", "private_key"))
            before = f"{filler} {name}{draw.choice((' = ', '=', ': ', ':'))}{draw.choice(('', chr(34), chr(39)))}" if draw.random() < 0.9 or not known else f"{filler} "
            path = draw.choice(("src/app.py", "config/prod.yml", "src3", ".env", "web", "src11"))
        else:
            form = draw.randrange(7)
            if form == 0:
                a = string.hexdigits[:16]
                value, before = text(draw.choice((32, 40, 64))), f"{filler} {draw.choice(('commit ', 'sha256: ', 'md5=', 'checksum ', 'revision '))}"
            elif form == 1:
                value, before = "_".join(draw.choice(some) for _ in range(draw.randint(3, 5))) + str(draw.randint(0, 99)), f"{filler} {draw.choice(('', 'name = ', 'call '))}"
            elif form == 2:
                value, before = draw.choice("xX0aA*1") * draw.randint(14, 32) + draw.choice("0a1"), f"{filler} {draw.choice(('token = ', 'password: ', 'key '))}"
            elif form == 3:
                value, before = "".join(draw.choice(some).capitalize() for _ in range(4)) + str(draw.randint(1, 9)), f"{filler} {draw.choice(('token = ', 'class ', ''))}"
            elif form == 4:
                value, before = str(draw.randint(10**14, 10**16)) + draw.choice(("", "e")), f"{filler} {draw.choice(('card ', 'phone ', 'id ', ''))}"
            elif form == 5:  # what is no secret after a telling name
                value = draw.choice(("true", "false", "null", "None", "required", "string", "str", "******", "${PASSWORD}", "<password>", "{{secret}}", "getpass()", "input(", draw.choice(some), draw.choice(some) + "_" + draw.choice(some), draw.choice(some) + "." + draw.choice(some)))
                before = f"{filler} {draw.choice(('token = ', 'password: ', 'auth=', 'secret: ', 'private: '))}{draw.choice(('', chr(34)))}"
            else:
                value, before = draw.choice(("your-api-key-here1", "insert_token_here_1", "example-secret-123", "changeme-password1", "test-token-000000")), f"{filler} {draw.choice(('token = ', 'api_key: ', 'secret='))}"
            path = draw.choice(("tests/fixtures/a.py", "docs/readme.md", "src/app.py", "examples/run.sh", "src2"))
        out.append((value, before, f" {filler}", path, known, good))
    return out


class Forest:
    """Trees on bootstrap samples, each split from a random part of the features, by the least Gini impurity."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 3):
        draw = np.random.default_rng(seed)
        self.trees = []
        for _ in range(trees):
            rows = draw.integers(0, len(x), len(x))
            nodes: list[list[float]] = []
            self._grow(x[rows], y[rows], depth, draw, nodes)
            self.trees.append(np.array(nodes))

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, draw: np.random.Generator, nodes: list) -> int:
        me = len(nodes)
        nodes.append([-1, 0, 0, 0, y.mean()])
        if depth == 0 or len(y) < 2 * LEAF or y.min() == y.max():
            return me
        best = (np.inf, 0, 0.0)
        for f in draw.choice(x.shape[1], max(1, int(x.shape[1] ** 0.5)), replace=False):
            order = np.argsort(x[:, f], kind="stable")
            v, s = x[order, f], np.cumsum(y[order])
            n = np.arange(1, len(y))
            cut = (v[1:] > v[:-1]) & (n >= LEAF) & (len(y) - n >= LEAF)
            if not cut.any():
                continue
            left, right = s[:-1], s[-1] - s[:-1]
            impurity = left * (1 - left / n) + right * (1 - right / (len(y) - n))
            impurity[~cut] = np.inf
            k = int(impurity.argmin())
            best = min(best, (impurity[k], int(f), (v[k] + v[k + 1]) / 2))
        if best[0] == np.inf:
            return me
        low = x[:, best[1]] <= best[2]
        nodes[me][0], nodes[me][1] = best[1], best[2]
        nodes[me][2] = self._grow(x[low], y[low], depth - 1, draw, nodes)
        nodes[me][3] = self._grow(x[~low], y[~low], depth - 1, draw, nodes)
        return me

    def chance(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for t in self.trees:
            at = np.zeros(len(x), np.int64)
            while (inner := t[at, 0] >= 0).any():
                rows = np.flatnonzero(inner)
                n = t[at[rows]]
                low = x[rows, n[:, 0].astype(np.int64)] <= n[:, 1]
                at[rows] = np.where(low, n[:, 2], n[:, 3]).astype(np.int64)
            total += t[at, 4]
        return total / len(self.trees)


def train(findings: list[tuple[str, str, str, str, bool, bool]] | None = None) -> Forest:
    findings = labelled_findings() if findings is None else findings
    x = np.array([features(*f[:5]) for f in findings])
    return Forest(x, np.array([f[5] for f in findings], float))


_DIGIT, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_DIGIT[48:58] = True
_LETTER[65:91] = _LETTER[97:123] = True


def candidates(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, str]]:
    """(text, start, end, kind) in bytes. What is assigned to a telling name is a candidate whatever it is; else
    only words of LEAST bytes with letters and digits are searched."""
    assigned: dict[int, dict[int, int]] = {}
    for t, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        for m in _ASSIGNED.finditer(data[a:b].tobytes()):
            k = m.lastindex
            end = m.end(k) if k < 3 else m.start(k) + len(m[k].rstrip(b",;\"'") or m[k])
            assigned.setdefault(t, {})[a + m.start(k)] = a + end
    known: set[tuple[int, int]] = set()
    _, starts, ends, first = words(data, offsets)
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
    able = (ends - starts >= LEAST) & (digits[ends] > digits[starts]) & (letters[ends] > letters[starts])
    at = np.flatnonzero(able)
    text = np.searchsorted(first, at, "right") - 1
    for t, a, b in zip(text.tolist(), starts[at].tolist(), ends[at].tolist()):
        word = data[a:b].tobytes()
        taken: list[tuple[int, int]] = []
        for kind, pattern in FORMATS:
            for m in pattern.finditer(word):
                taken.append(m.span())
                known.add((a + m.start(), a + m.end()))
                yield t, a + m.start(), a + m.end(), kind
        for m in _RUN.finditer(word):
            s, e = m.span()
            run = m[0]
            if b"=" in run[:-2]:  # name=value
                s += run[:-2].rindex(b"=") + 1
            run = word[s:e].strip(b"=-_/")
            if len(run) >= LEAST and not any(x < e and s < y for x, y in taken) and any(48 <= c < 58 for c in run) and any(c >= 65 for c in run):
                if assigned.get(t, {}).get(a + s, 0) < a + e:  # else it begins a value that is a candidate as a whole
                    yield t, a + s, a + e, "generic"
    for t, spans in assigned.items():
        yield from ((t, a, b, "assigned") for a, b in spans.items() if (a, b) not in known)


def scan(docs: DataFrame, forest: Forest | None = None, limit: float = LIMIT) -> DataFrame:
    """docs: doc_id, source (the path), text. Out: a row for each candidate, in code points; secret: whether the forest keeps it."""
    forest = forest or train()
    held = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = strings(batch["text"])
            paths = batch["source"].to_pylist()
            ids, rows, x = batch["doc_id"].to_pylist(), [], []
            for i, j in blocks(offsets):
                part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                for t, a, b, kind in candidates(part, at):
                    decode = lambda p, q: part[p:q].tobytes().decode(errors="ignore")
                    value = decode(a, b)
                    before, after = decode(max(at[t], a - 80), a), decode(b, min(at[t + 1], b + 40))
                    start = int(((part[at[t] : a] & 0xC0) != 0x80).sum())
                    rows.append((ids[i + t], start, len(value), kind, hashlib.sha256(value.encode()).hexdigest()))
                    x.append(features(value, before, after, paths[i + t] or "", kind not in ("generic", "assigned")))
            chance = held.value.chance(np.array(x)) if x else np.zeros(0)
            columns = list(zip(*rows)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.record_batch([*(pa.array(c, k) for c, k in zip(columns, kinds)), pa.array(chance), pa.array(chance >= limit)], names=["doc_id", "start", "length", "kind", "value_sha256", "chance", "secret"])

    return docs.select("doc_id", "source", "text").mapInArrow(run, "doc_id long, start long, length long, kind string, value_sha256 string, chance double, secret boolean")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
