"""Golden values, invariants, and every query against its SQL on the smallest tables."""

import ast
import decimal
import itertools
import math
from datetime import datetime

import duckdb
import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.functions import calls, markup, text, tokenizer, vectors
from weftline.operators import graph, linking, neighbours, ranking, training, vocabulary
from weftline.plans import catalogue
from weftline.sources import files, lines

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, str | bool | int):
        return v
    if isinstance(v, float | decimal.Decimal):
        return None if math.isnan(v) else float(f"{float(v):.9g}")
    if isinstance(v, list | tuple | np.ndarray):
        return tuple(plain(x) for x in v)
    return v.item() if hasattr(v, "item") else v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, FOLDER)
    got = duck.execute(catalogue.ORACLES[name])
    columns = [c[0] for c in got.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted((tuple(plain(x) for x in r) for r in got.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert catalogue.QUERIES[name](spark, FOLDER).count() > 0


def ranked(spark, *lists):
    rows = [(q, i, r) for q, rs in enumerate(lists) for i, r in enumerate(rs, 1)]
    return spark.createDataFrame(rows, "query int, rank int, rel int")


def only(df, name):
    return [r[name] for r in df.orderBy("query").collect()]


def test_golden_measures(spark):
    close = lambda a, b: np.allclose(a, b, atol=1e-9)
    for lists, want in (([[0, 0, 1], [0, 1, 0], [1, 0, 0]], 0.6111111111), ([[0, 0, 0], [0, 1, 0], [1, 0, 0]], 0.5), ([[0, 0, 0, 1], [1, 0, 0], [1, 0, 0]], 0.75)):
        assert close(np.mean(only(ranking.reciprocal_rank(ranked(spark, *lists)), "rr")), want)
    assert close(only(ranking.r_precision(ranked(spark, [0, 0, 1], [0, 1, 0], [1, 0, 0])), "r_precision"), [1 / 3, 0.5, 1])
    assert [only(ranking.precision_at(ranked(spark, [0, 0, 1]), k), "precision")[0] for k in (1, 2)] == [0, 0] and only(ranking.precision_at(ranked(spark, [0, 0, 1]), 4), "precision") == [None]
    assert close(only(ranking.average_precision(ranked(spark, [1, 1, 0, 1, 0, 1, 0, 0, 0, 1], [0])), "ap"), [0.7833333333, 0])
    r = [3, 2, 3, 0, 0, 1, 2, 2, 3, 0]
    for k, method, want in ((1, 0, 3), (1, 1, 3), (2, 0, 5), (2, 1, 4.2618595071), (10, 0, 9.6051177392), (11, 0, 9.6051177392)):
        assert close(only(ranking.dcg(ranked(spark, r), k, method), "dcg"), [want])
    assert close(only(ranking.ndcg(ranked(spark, r), 1), "ndcg"), [1])
    assert close([only(ranking.ndcg(ranked(spark, [2, 1, 2, 0]), 4, m), "ndcg")[0] for m in (0, 1)], [0.9203032078, 0.9651954696])
    assert only(ranking.ndcg(ranked(spark, [0]), 1), "ndcg") == [0]


def test_golden_numbers(spark):
    cases = {"12 34 abc 5": "dddddd dddddd abc dddddd", "x 1 2 3 y 4": "x dddddd y dddddd", "1 2b": "dddddd 2b", "a1 2b 33": "a1 2b dddddd", " ": "dddddd", "": ""}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", text.regularize(F.col("t")).alias("r")).collect()
    assert {r["t"]: r["r"] for r in got} == cases


def test_merges(spark):
    words = [("l o w </w>", 5), ("l o w e r </w>", 2), ("n e w e s t </w>", 6), ("w i d e s t </w>", 3)]
    df = spark.createDataFrame(words, "w string, cn long").select(F.split("w", " ").alias("symbols"), "cn")
    merges = vocabulary.learn_merges(df, 3)
    assert merges == [("e", "s", 9), ("es", "t", 9), ("est", "</w>", 9)]


def test_matching_is_the_best():
    draw = np.random.default_rng(1)
    assert training.matching(np.array([[0, 1, 2], [3, 4, 5]]))[1] == 6
    for _ in range(40):
        m = int(draw.integers(1, 5))
        w = draw.random((m, int(draw.integers(m, 6))))
        found, total = training.matching(w)
        assert len(set(found.tolist())) == m
        assert math.isclose(total, max(sum(w[i, p[i]] for i in range(m)) for p in itertools.permutations(range(w.shape[1]), m)))


@pytest.mark.parametrize("mode", training.MODES)
def test_update_rules_follow_the_gradient(mode):
    g = np.array([1.0, -2.0, 0.5])
    change, first, second = training.step(mode, g, np.zeros(3), np.zeros(3), 0.05, 0.9, 0.1)
    assert (np.sign(change) == np.sign(g)).all() and (np.abs(change) <= 0.1).all()


def test_markup():
    assert markup.balanced("a [[b [[c]] d]] e [[f") == [(2, 15)]
    assert markup.drop_nested("a{{b{{c}}}}d{{e") == "ad{{e"
    assert markup.internal_links("[[a|b]]c [[File:x|[[y]]]] [[d]]") == "bc  d"
    assert markup.clean("'''x''' [http://a b] &lt;<ref>no</ref>") == "x b <"
    t = markup.Templates({"loop": "{{loop}}", "a": "{{{1|d}}}-{{{x|}}}", "Sw": "{{#switch:{{{1}}}|a|b=1|#default=2}}"})
    assert t.expand("{{a}} {{a|1|x=2}} {{loop}}{{none}}") == "d- 1-2 "
    assert [t.expand("{{sw|%s}}" % x) for x in "abc"] == ["1", "1", "2"]
    assert [markup.roman(n) for n in (1, 4, 1994, 0)] == ["I", "IV", "MCMXCIV", "0"]
    assert markup.compact("== A ==\n== B ==\ntext\n* item\n", True, True) == ["B.", "text", "- item"]
    assert markup.tag_offsets("a<b>c</b>") == ("ac", [0, 4])


def test_templates_of_many_parameters():
    """The depth is bounded, the number isn't."""
    body = "".join("{{{%d|d}}}," % i for i in range(1, 41))
    t = markup.Templates({"box": body, "deep": "{{{a|" * 20 + "x" + "}}}" * 20})
    assert t.expand("{{box|" + "|".join(map(str, range(1, 40))) + "}}") == "".join(f"{i}," for i in range(1, 40)) + "d,"
    assert t.expand("{{deep}}{{deep|a=b}}") == "xb"


def test_expressions():
    cases = {
        "1 + 2 * 3": "7", "(1 + 2) * 3": "9", "7 / 2": "3.5", "4 / 2": "2", "2 ^ 3 ^ 2": "64", "-2 ^ 2": "4", "- 8 mod 3": "-2", "9.876 round 2": "9.88", "-2.5 round 0": "-3",
        "1 = 1 and 2 <> 3": "1", "not 1 or 0": "0", "3 >= 4": "0", "abs -3 + ceil 1.2": "5", "1/3": "0.33333333333333", "2 * pi": "6.2831853071796", " ": "", "10 - 3 - 2": "5", "1e3": None,
        "1 / 0": None, "2 +": None, "(1": None, "9 ^ 9999": None, "__import__('os')": None, "1 2": None, "(" * 5000: None, "sqrt -1": None, "5 mod 0": None,
    }
    for text, value in cases.items():
        assert calls.expression(text) == (f'<span class="error">{text.strip()}</span>' if value is None else value), text


@given(st.recursive(st.integers(0, 50).map(str), lambda x: st.tuples(x, st.sampled_from("+-*"), x).map(lambda t: f"({t[0]} {t[1]} {t[2]})"), max_leaves=12))
def test_expressions_of_whole_numbers(text):
    assert calls.expression(text) == str(ast_value(text))


def ast_value(text):
    def value(node):
        if isinstance(node, ast.Constant):
            return node.value
        a, b = value(node.left), value(node.right)
        return a + b if isinstance(node.op, ast.Add) else a - b if isinstance(node.op, ast.Sub) else a * b

    return value(ast.parse(text, mode="eval").body)


def test_text_modules():
    def s(f, *a, **k):
        return calls.invoke("String", f, {str(i): x for i, x in enumerate(a, 1)} | k)

    assert [s("len", "abc"), s("len", s="abcd"), s("len")] == ["3", "4", "0"]
    assert [s("sub", "abcdef", "2", "4"), s("sub", "abcdef", "-3"), s("sub", "abcdef", "2", "-2"), s("sublength", "abcdef", "3", "2")] == ["bcd", "def", "bcde", "cd"]
    assert [s("pos", "abc", "2"), s("pos", "abc", "-1"), s("pos", "abc", "9"), s("rep", "ab", "3"), s("rep", "ab", "9999999")] == ["b", "c", "", "ababab", ""]
    assert [s("find", "banana", "an"), s("find", "banana", "an", "3"), s("find", "banana", "[n]a$", plain="false"), s("find", "", "x")] == ["2", "4", "5", "0"]
    assert [s("replace", "a.b.c", ".", "-"), s("replace", "a.b.c", ".", "-", "1"), s("replace", "ab", "[", "x", plain="no")] == ["a-b-c", "a-b.c", ""]
    assert [calls.invoke("Roman", "main", {"1": x}) for x in ("1994", "0", "5000", "x")] == ["MCMXCIV", "", "N/A", ""]
    assert calls.invoke("If empty", "main", {"1": "", "2": "b"}) == "b" and calls.invoke("none", "main", {}) == ""
    assert calls.invoke("convert", "convert", {"1": "5", "2": "km"}) == "5 km"


def test_calls_in_templates():
    t = markup.Templates({"If empty": "{{#invoke:If empty|main}}", "Alias": "#REDIRECT [[Template:Real]]", "real": "<{{{1}}}>", "A": "#redirect [[B]]", "B": "#redirect [[A]]"})
    assert t.expand("{{if empty||b}} {{alias|x}} [{{a}}] {{#iferror:{{#expr:1/0}}|bad|good}} {{real|{{#switch:q|q=r}}}}") == "b <x> [] bad <r>"
    words = calls.page_words("Help:Top/Mid/Low", {"Help": "12"}, datetime(2020, 3, 4, 5, 6, 7))
    assert t.page("{{PAGENAME}} {{NAMESPACE}} {{NAMESPACENUMBER}} {{BASEPAGENAME}} {{SUBPAGENAME}} {{ROOTPAGENAME}} {{CURRENTTIME}}{{!}}", words) == "Top/Mid/Low Help 12 Top/Mid Low Top 05:06:07|"
    assert calls.page_words("a: b", {"Help": "12"}, datetime(2020, 1, 1))["PAGENAME"] == "a: b" and t.expand("{{PAGENAME}}") == ""


def test_anchors_over_tokens():
    run = tokenizer.token_anchors
    assert run("The [[Big Cat|big cats]]' 12.5% of [[x]]-[[y|]] İ [[z|...]]!") == "the [[Big Cat|big cats]] dddddd of [[x|x]] İ"
    assert run("[[a|b]][[c|d]] [[e|f g]]", entity={"a": "1", "e": "2"}.get) == "[[1|bd]] [[2|f g]]"
    assert run("") == "" and run("no, anchors") == "no anchors"
    stems = lambda text: ((w, a, b, w.rstrip("s")) for w, a, b, _ in tokenizer.words_and_signs(text))
    assert run("Cats and [[Dog|dogs]]", stems) == "cat and [[Dog|dog]]"


def test_tokenized(spark):
    rows = spark.createDataFrame([(1, "it's über-good: 5"), (2, None), (3, "")], "id int, `a b` string")
    got = {r["id"]: r["tokens"] for r in tokenizer.tokenized(rows, "a b").collect()}
    assert [(x.word, x.start, x.end) for x in got[1]] == [("it's", 0, 4), ("über-good", 5, 14), (":", 14, 15), ("5", 16, 17)] and got[2] is None and got[3] == []


def test_vector_files(spark, tmp_path):
    draw = np.random.default_rng(2)
    rows = [(f"w{i}", [draw.random(4).astype("f4"), draw.random(4).astype("f4")]) for i in range(5)]
    (tmp_path / "v.bin").write_bytes(files.vector_bytes(rows))
    got = {r["label"]: r for r in files.read_vectors(spark, str(tmp_path / "v.bin"), 2).collect()}
    for label, (v, m) in rows:
        assert np.allclose(got[label]["vec"], v) and np.allclose(got[label]["mu"], m)
    assert files.read_vectors(spark, str(tmp_path / "v.bin"), 2, first=3).count() == 3


def test_page_dump(spark, tmp_path):
    page = lambda i, ns, body: f"<page><title>T{i}</title><ns>{ns}</ns><id>{i}</id>{body}<revision><id>{i * 10}</id><text>x{i}</text></revision></page>"
    (tmp_path / "d.xml").write_text("<mediawiki>" + page(1, 0, "") + page(2, 0, '<redirect title="T1" />') + page(3, 10, "") + "</mediawiki>")
    dump = files.pages(spark, str(tmp_path / "d.xml"))
    assert [r["id"] for r in files.articles(dump).collect()] == [1]
    assert [tuple(r) for r in files.redirects(dump).collect()] == [("T2", "T1")] and files.templates(dump).first()["title"] == "T3"


def test_lines_of_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ttwo\nbroken\nthree\tfour\n")
    rows = lines.rows_of(lines.lines(spark, str(tmp_path / "a.txt")).select("n", "value"), ["a", "b"]).collect()
    assert sorted((r["n"], r["a"], r["b"]) for r in rows) == [(0, "one", "two"), (2, "three", "four")]
    ordered = lines.ordered_lines(spark, str(tmp_path / "a.txt")).orderBy("n").collect()
    assert [r["value"] for r in ordered] == ["one\ttwo", "broken", "three\tfour"]


def test_expression_parser():
    assert neighbours.parse_expression("w:en:king - w:en:man + e:es:reina madre") == [(1, "w", "en", "king"), (-1, "w", "en", "man"), (1, "e", "es", "reina madre")]
    with pytest.raises(ValueError):
        neighbours.parse_expression("nothing")


def test_uniform_depends_on_keys_alone(spark):
    u = spark.range(2000).select(vectors.uniform(F.lit(3), F.col("id")).alias("u"))
    a, b = [sorted(r["u"] for r in d.collect()) for d in (u, u.repartition(7))]
    assert a == b and 0.45 < np.mean(a) < 0.55


def test_nearest_and_analogies_are_exact_in_blocks(spark, monkeypatch):
    """Against brute force, with equal vectors, a zero vector and blocks that end inside the rows; tasks hold bounded blocks."""
    draw = np.random.default_rng(3)
    x = draw.normal(size=(90, 4)).astype("f4").astype(float)
    x[40:55], x[60] = x[3], 0
    for name, value in (("ROUND", 7), ("BLOCK", 3), ("ROWS", 8)):
        monkeypatch.setattr(neighbours, name, value)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    norms = np.linalg.norm(x, axis=1)
    cos = np.where(np.outer(norms, norms) > 0, (x @ x.T / np.maximum(np.outer(norms, norms), 1e-12) + 1) / 2, 0)
    asked = rows.where("id % 4 = 0").select(F.col("id").alias("q"), "vec")
    distance = lambda dot, a, b: a * a + b * b - 2 * dot
    for score, want, largest in ((neighbours.scaled, cos, True), (distance, distance(x @ x.T, norms[:, None], norms[None, :]), False)):
        got = {(r["q"], r["rank"]): r["id"] for r in neighbours.nearest(asked, rows, 5, score, largest).collect()}
        for q in range(0, 90, 4):
            best = sorted((i for i in range(90) if i != q), key=lambda i: ((-1 if largest else 1) * round(want[q, i], 9), i))[:5]
            assert [got[q, k] for k in range(1, 6)] == best
    u = x / np.maximum(norms, 1e-12)[:, None]
    questions = spark.createDataFrame([(q, q, q + 1, q + 2, q + 3, q // 10) for q in range(0, 80, 5)], "q long, a long, b long, c long, d long, section long")
    got = {r["q"]: r["found"] for r in neighbours.analogies(questions, rows).collect()}
    for q in range(0, 80, 5):
        s = u @ (u[q + 1] - u[q] + u[q + 2])
        best = sorted((-round(s[i], 9), i) for i in range(90) if i not in (q, q + 1, q + 2) and round(s[i], 9) > 0)
        assert got.get(q) == (best[0][1] if best else None)


def test_tokens_come_in_blocks(monkeypatch):
    """What is held at once is bounded by the texts' bytes, not by the rows of a batch."""
    import pyarrow as pa

    monkeypatch.setattr(tokenizer, "BLOCK", 10)
    texts = ["one two", None, "three", "", "a long text alone", "x", None]
    blocks = [b["t"].to_pylist() for b in tokenizer._blocks(pa.record_batch({"t": texts}), 0)]
    assert blocks == [["one two", None], ["three", ""], ["a long text alone"], ["x", None]]


def test_rounding_keeps_the_sign_of_zero(spark, duck):
    """As SQL rounds: to -0.0 what is just below 0."""
    values = [-1e-9, 1e-9, -0.0, 0.0, -0.0000005, 0.0000005, -1.25, 0.1234565, -7.5e-7, float("inf"), None]
    got = [r["r"] for r in spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x double").select("i", vectors.rounded(F.col("x"), 6).alias("r")).orderBy("i").collect()]
    assert [str(x) for x in got] == [str(duck.execute("SELECT round(?::DOUBLE, 6)", [x]).fetchall()[0][0]) for x in values]
    raw = spark.createDataFrame([(1, s, w, 0.5, [x]) for w, (s, x) in enumerate(((1, 2e-9), (2, 6e-9)))], "pair long, side int, word long, weight double, vec array<double>")
    step = training.regression_step(raw).select("word", F.transform("gradient", lambda x: vectors.rounded(x, 6)).alias("g"))
    assert {r["word"]: str(r["g"]) for r in step.collect()} == {0: "[0.0]", 1: "[-0.0]"}


def test_coherence_in_cells(spark, monkeypatch):
    """A large document is many bounded cells; one without context and one of context alone."""
    monkeypatch.setattr(linking, "SIDE", 4)
    draw = np.random.default_rng(5)
    x = {("a", i): draw.normal(size=3) for i in range(23)} | {("b", i): draw.normal(size=3) for i in range(2)} | {("c", 0): draw.normal(size=3)}
    x["a", 5] = np.zeros(3)
    rows = lambda keep: spark.createDataFrame([(d, i // 3, i, v.tolist()) for (d, i), v in x.items() if keep(d, i)], "doc string, mention_id int, entity int, vec array<double>")
    context = {k: v for k, v in x.items() if k[0] != "b" and k[1] % 2 == 0}
    nowhere = spark.createDataFrame([(None, 7, 7, [1.0, 0.0, 0.0])], "doc string, mention_id int, entity int, vec array<double>")
    out = linking.coherence(rows(lambda d, i: d != "c").union(nowhere), rows(lambda d, i: (d, i) in context).union(nowhere))
    assert "MapCoGroups" in out._jdf.queryExecution().toString()
    got = {(r["doc"], r["entity"]): (r["csim_max"], r["csim_mean"]) for r in out.collect()}
    cos = lambda a, b: (a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) + 1) / 2 if a.any() and b.any() else 0.0
    assert len(got) == 26 and got.pop((None, 7)) == (0.0, 0.0)
    for (d, i), found in got.items():
        s = [cos(x[d, i], v) for (e, _), v in context.items() if e == d] or [0.0]
        assert np.allclose(found, (max(s), np.mean(s)), atol=1e-9)


def test_spearman_by_slices(spark):
    """Ranks with ties, missing values and a group without a key, whatever the slices; no group is ranked in one task."""
    draw = np.random.default_rng(6)
    rows = [(g, None if k % 17 == 0 else float(draw.integers(-4, 5)), float(draw.normal()) if g != "c" else 2.0) for g in ("a", None, "c") for k in range(60)]
    out = ranking.spearman(spark.createDataFrame(rows, "g string, x double, y double"), "g", "x", "y", 7)
    assert "rank(" not in out._jdf.queryExecution().toString()
    got = {r["g"]: r["rho"] for r in out.collect()}
    mean_rank = lambda v: np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
    for g in ("a", None):
        x, y = (np.array([r[i] or 0.0 for r in rows if r[0] == g]) for i in (1, 2))
        assert math.isclose(got[g], np.corrcoef(mean_rank(x), mean_rank(y))[0, 1], abs_tol=1e-9)
    assert got["c"] is None


def test_sums_over_lines_go_by_slices(spark, monkeypatch):
    """A file's sections, documents and offsets are the same when its lines are dealt over tasks."""
    monkeypatch.setattr(lines, "SLICE", 3)
    draw = np.random.default_rng(7)
    kinds = ["-DOCSTART-", "a\tB\tm\tx\te", "a\tI\tm\tx\te", "a\tO", "<TEXT>", "</TEXT>", ": s", "one two three four"]
    rows = [(f, n, kinds[int(draw.integers(0, 8))]) for f in "fg" for n in range(-2, 40)]
    df = spark.createDataFrame(rows, "file string, n long, value string")
    docs, ks, want = {}, {}, {}
    for f, n, v in rows:
        docs[f] = docs.get(f, 0) + (v == "-DOCSTART-")
        ks[f] = ks.get(f, 0) + ("\tB\t" in v)
        if "\tB\t" in v or "\tI\t" in v:
            want[f, docs[f], ks[f]] = want.get((f, docs[f], ks[f]), 0) + 1
    for f in "fg":
        got = lines.conll(df.where(F.col("file") == f)).collect()
        assert sorted((r["doc"], r["length"]) for r in got) == sorted((d, c) for (g, d, _), c in want.items() if g == f)
    before = {"f": -1, "g": -1}
    offsets = {(r["file"], r["n"]): r["offset"] for r in lines.forum_offsets(df).collect()}
    for f, n, v in rows:
        assert offsets.get((f, n)) == (None if v.startswith("<") else before[f])
        before[f] += len(v) + 1
    depth = {"f": 0, "g": 0}
    inside = {(r["file"], r["n"]) for r in lines.in_region(df).collect()}
    for f, n, v in rows:
        depth[f] += (v == "<TEXT>") - (v == "</TEXT>")
        assert ((f, n) in inside) == (depth[f] > 0 and not v.startswith("<"))


def test_coverage_by_pairs(spark):
    """Gold entities are found by a join, not in a list for each mention; missing values match nothing."""
    m = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("a", None, "y"), (None, 1, "y"), ("b", 1, None), ("c", 5, "z")], "mention string, entity int, g string")
    c = spark.createDataFrame([("a", 1), ("a", 1), ("a", None), ("b", None), (None, 1)], "mention string, entity int")
    out = graph.coverage(m, c, F.col("g"))
    assert "collect_set" not in out._jdf.queryExecution().toString()
    assert {tuple(r) for r in out.collect()} == {("x", 2, 2, 1), ("y", 2, 1, 0), (None, 1, 1, 0), ("z", 1, 0, 0)}


def test_merges_read_the_words_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for rows in batches:
            seen.add(len(rows))
            yield rows

    words = spark.createDataFrame([("l o w", 5), ("l o w e r", 2), ("n e w e s t", 6)], "w string, cn long").mapInPandas(count, "w string, cn long")
    assert vocabulary.learn_merges(words.select(F.split("w", " ").alias("symbols"), "cn"), 4)[0] == ("w", "e", 8)
    assert seen.value == 3


def test_template_rows_are_dealt(spark):
    """Many rows can lie in a small file, which one task would read."""
    assert catalogue.QUERIES["template_calls"](spark, FOLDER).rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism


def test_pairs_are_counted_in_parts_of_bounded_size(spark):
    pairs = spark.createDataFrame([(k % 5, k % 3) for k in range(60)], "src long, dst long")
    out = training.pair_counts(pairs, 60, 4)
    assert out.rdd.getNumPartitions() == 15
    assert {tuple(r) for r in out.collect()} == {(a, b, 4) for a in range(5) for b in range(3)}
