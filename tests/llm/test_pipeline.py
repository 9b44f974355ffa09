"""The stages of corpus_pipeline against brute force, on a small table with nulls, repeated ids and clashing names."""

import collections
import random
import re
import types

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from weftline.llm import language_id, mixing, near_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, whole string, lang_pred string, segments long"
WORD = "[^\x20\x09-\x0d]+"


def rows() -> list[tuple]:
    draw = random.Random(9)
    vocabulary = ["".join(draw.choice("abcdefghi") for _ in range(draw.randint(2, 7))) for _ in range(400)]
    base = [[draw.choice(vocabulary) for _ in range(80)] for _ in range(6)]
    texts = [None, "", " \n ", "123 456", "one", "One\tTwo"]
    for k in range(40):
        near = list(base[k % 6])
        for _ in range(k % 4):
            near[draw.randrange(80)] = draw.choice(vocabulary)
        texts.append(" ".join(near) + ("\n a line that many documents hold \nend " + str(k) if k % 3 == 0 else ""))
    out = [(i, t, "en" if i % 2 else "de", draw.choice(["s1", "s2", None]), len(t or ""), 7, "w", "x", 8) for i, t in enumerate(texts)]
    return out + [out[10], (None, *out[11][1:]), (12, "another text under a known doc_id", *out[12][2:])]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def test_language_id_keeps_what_has_letters(spark, docs):
    got = corpus_pipeline.identify_language(spark, docs, "")
    assert got.columns == docs.columns
    want = [r for r in rows() if any(c.isalpha() for c in r[1] or "")]
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(want)


def test_language_id_sends_a_text_once_and_returns_blocks(spark, docs, monkeypatch):
    """What a task holds doesn't grow with copies of the texts or with a batch's results."""
    schemas, kind = [], type(docs)
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, schema, *a, run=kind.mapInArrow, **b: schemas.append((self.schema.simpleString(), schema)) or run(self, f, schema, *a, **b))
    corpus_pipeline.identify_language(spark, docs, "")
    assert len(schemas) == 1 and all(len(re.findall(r"\btext\b", x)) == 1 for x in schemas[0])

    pieces = language_id.pieces_of(language_id.default_vocabulary()).pieces
    chances = np.append(np.full((len(pieces), 2), 1 / len(pieces)), np.zeros((1, 2)), axis=0)
    held = types.SimpleNamespace(value=language_id.Model(language_id.default_vocabulary(), ["de", "en"], chances, np.zeros(2)))
    texts = ["some words " * 9000, None, "", "1 2", "x y " * 400_000] * 8
    batch = pa.record_batch({"doc_id": list(range(40)), "text": texts, "rest": [{"_": i} for i in range(40)]})
    out = list(language_id._predictor(held, "blocks")(iter([batch])))
    assert len(out) > 8 and all(len(b) == 1 or sum(len(t or "") for t in b["text"].to_pylist()) <= language_id.BLOCK for b in out)
    found = [(r["doc_id"], r["text"], r["lang_pred"], r["rest"]["_"]) for b in out for r in b.to_pylist()]
    assert found == [(i, t, "de" if i % 5 in (0, 4) else "und", i) for i, t in enumerate(texts)]


def test_line_dedup(spark, docs):
    got = corpus_pipeline.dedup_lines(spark, docs, "")
    assert got.columns == docs.columns
    held = collections.defaultdict(list)  # each row counts as a document, a null doc_id is the smallest
    for d, t, *_ in rows():
        for key in {x.strip(" \t\n\v\f\r").lower() for x in (t or "").split("\n")}:
            held[key].append(-1 if d is None else d)
    out, want = sorted((tuple(r) for r in got.collect()), key=str), []
    for r in rows():
        own = -1 if r[0] is None else r[0]
        keys = [(x, x.strip(" \t\n\v\f\r").lower()) for x in (r[1] or "").split("\n")]
        text = "\n".join(x for x, k in keys if len(k) < 20 or len(held[k]) < 3 or max(held[k]) == own)
        want.append((r[0], text, *r[2:4], len(text), *r[5:]))
    assert out == sorted(want, key=str)


def test_near_dedup_keeps_one_of_each_group(spark, docs):
    got = corpus_pipeline.dedup_near(spark, docs, "")
    assert got.columns == docs.columns
    own = dict(enumerate(rows()))
    found = near_dedup.brute_force({i: r[1] for i, r in own.items()}, 5, 80)
    groups = collections.defaultdict(list)
    for i, (n, component) in found.items():
        groups[component if n else ("alone", i)].append(own[i])
    kept = collections.Counter(tuple(r) for r in got.collect())
    assert sum(kept.values()) == len(groups)
    for some in groups.values():
        least = min((r[0] for r in some if r[0] is not None), default=None)
        assert sum(kept[r] > 0 for r in set(some) if r[0] == least) >= 1


def test_mixing_takes_what_the_targets_ask(spark, docs):
    got = corpus_pipeline.mix(spark, docs, "")
    assert got.columns == docs.columns
    sizes, taken = collections.Counter(), collections.Counter()
    for r in rows():
        sizes[r[3]] += len(re.findall(WORD, r[1] or ""))
    for r in got.collect():
        taken[r["source"]] += len(re.findall(WORD, r["text"]))
        assert r["n_chars"] == len(r["text"]) and (r["row"], r["whole"], r["segments"]) == (7, "w", 8)
    for s, t in mixing.targets(dict(sizes)).items():
        assert abs(taken[s] - t) <= 1


def test_stages_of_an_empty_table(spark, docs):
    none = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, "")
        assert out.collect() == [] and (name == "packing" or out.columns == docs.columns)


def test_run_goes_through_all_stages(spark, docs, tmp_path):
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    last = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        last = spark.createDataFrame(stage(spark, last, "").collect(), last.schema)
    assert {p["doc_id"] for p in pieces} == {r["doc_id"] for r in last.collect()}
