"""Queries on vectors, neighbours and measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import vectors as V
from weftline.operators import neighbours as N
from weftline.operators import ranking as R

from .base import query

#: Nearest rows in DuckDB: rank by the rounded scaled cosine, ties by id.
E_ = "e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"
KNN = E_ + """, s AS (SELECT q.id AS q, r.id, r.label AS rl, q.label AS ql, round((list_cosine_similarity(q.v, r.v) + 1) / 2, 9) AS score FROM e q, e r WHERE q.id % 20 = 0 AND q.id <> r.id),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM s)"""


def vecs(t):
    return t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def found(t, k=10):
    rows = vecs(t)
    return N.nearest(rows.where("id % 20 = 0").select(F.col("id").alias("q"), "vec"), rows, k)


def lists(t, k=10):
    """Ranked lists: a neighbour is relevant where it has the query's label."""
    f, rows = found(t, k), vecs(t)
    j = f.join(rows.select("id", F.col("label").alias("rl")), "id").join(rows.select(F.col("id").alias("q"), F.col("label").alias("ql")), "q")
    return j.select(F.col("q").alias("query"), "rank", (F.col("rl") == F.col("ql")).cast("int").alias("rel"))


LISTS = "WITH " + KNN + ", l AS (SELECT q AS query, rank, CAST(rl = ql AS INT) AS rel FROM k WHERE rank <= 10) "


@query("WITH " + KNN + " SELECT q, id, round(score, 6) AS score, rank FROM k WHERE rank <= 10")
def knn_cosine(t):
    return found(t).select("q", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("WITH " + KNN + " SELECT q, id, round(score, 6) AS score, rank FROM k WHERE rank <= 3")
def knn_expressions(t):
    rows = vecs(t)
    q = rows.where("id % 20 = 0").select(F.col("id").alias("q"), "vec")
    f = N.nearest(q, rows, 3, N.scaled)
    return f.select("q", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


PAIRS = "WITH " + E_ + ", p AS (SELECT a.id, a.v AS a, b.v AS b FROM e a JOIN e b ON b.id = a.id + 1) "


def pairs(t):
    r = vecs(t)
    return r.select("id", F.col("vec").alias("a")).join(r.select((F.col("id") - 1).alias("id"), F.col("vec").alias("b")), "id")


@query(PAIRS + """SELECT id, round(list_cosine_similarity(a, b), 6) AS cos, round((list_cosine_similarity(a, b) + 1) / 2, 6) AS scaled, round(list_dot_product(a, b), 6) AS dot,
  round((0.5 * list_cosine_similarity(a, b) + 1) / 2, 6) AS rho, round(1 / (1 + exp(-greatest(-6, least(6, list_dot_product(a, b))))), 6) AS inner_sig FROM p""")
def pair_similarity(t):
    a, b = F.col("a"), F.col("b")
    r6 = lambda c, n: V.rounded(c, 6).alias(n)
    return pairs(t).select("id", r6(V.cosine(a, b), "cos"), r6(V.scaled_cosine(a, b), "scaled"), r6(V.dot(a, b), "dot"), r6(V.similarity(a, b, 0.5), "rho"), r6(V.similarity(a, b, 1.0, True), "inner_sig"))


@query(PAIRS + "SELECT id, list_transform(list_zip(a, b), lambda z: round(z[1] + z[2], 6)) AS plus, list_transform(a, lambda x: round(x / sqrt(list_dot_product(a, a)), 6)) AS unit FROM p")
def vector_arithmetic(t):
    each = lambda v: F.transform(v, lambda x: V.rounded(x, 6))
    return pairs(t).select("id", each(V.plus(F.col("a"), F.col("b"))).alias("plus"), each(V.unit(F.col("a"))).alias("unit"))


CENTRES = E_ + ", x AS (SELECT label, unnest(v) AS x, unnest(range(1, 65)) AS i FROM e), m AS (SELECT label, i, avg(x) AS x, count(*) AS n FROM x GROUP BY label, i), c AS (SELECT label, max(n) AS n, list(x ORDER BY i) AS mean FROM m GROUP BY label)"


@query("WITH " + CENTRES + " SELECT label, n, list_transform(mean, lambda x: round(x, 6)) AS mean FROM c")
def label_centroid(t):
    return N.means(vecs(t), "label").select("label", "n", F.transform("mean", lambda x: V.rounded(x, 6)).alias("mean"))


@query("WITH " + CENTRES + ", s AS (SELECT e.id, c.label, round(list_cosine_similarity(e.v, c.mean), 9) AS s FROM e, c) SELECT id, arg_min(label, (-s, label)) AS nearest, round(max(s), 6) AS score FROM s GROUP BY id")
def nearest_centroid(t):
    centres = N.means(vecs(t), "label").select("label", F.col("mean").alias("m"))  # one row a label
    s = vecs(t).select("id", "vec").crossJoin(F.broadcast(centres)).select("id", "label", F.round(V.cosine(F.col("vec"), F.col("m")), 9).alias("s"))
    best = s.groupBy("id").agg(F.min(F.struct((-F.col("s")).alias("n"), "label")).alias("b"))
    return best.select("id", F.col("b.label").alias("nearest"), F.round(-F.col("b.n"), 6).alias("score"))


@query("WITH " + E_ + """, x AS (SELECT list_transform(list_zip(list_transform(list_zip(a.v, b.v), lambda z: z[1] - z[2]), c.v), lambda z: z[1] + z[2]) AS t FROM e a, e b, e c WHERE a.id = 3 AND b.id = 5 AND c.id = 8)
  SELECT CAST(id AS VARCHAR) AS item, round((list_cosine_similarity(v, t) + 1) / 2, 6) AS score FROM e, x ORDER BY (list_cosine_similarity(v, t) + 1) / 2 DESC, item LIMIT 10""")
def neighbors_expr(t):
    store = vecs(t).select(F.col("id").cast("string").alias("item"), "vec")
    out = N.neighbours("w:en:3 - w:en:5 + w:en:8", {("w", "en"): store}, ("w", "en"))
    return out.select("item", F.round("score", 6).alias("score"))


ANALOGY = "WITH " + E_ + """, u AS (SELECT id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM e),
q AS (SELECT id AS q, id AS a, id + 1 AS b, id + 2 AS c, id + 3 AS d, id // 100 AS section FROM e WHERE id % 20 = 0),
t AS (SELECT q, section, q.a, q.b, q.c, d, list_transform(list_zip(list_transform(list_zip(ub.u, ua.u), lambda z: z[1] - z[2]), uc.u), lambda z: z[1] + z[2]) AS t
  FROM q JOIN u ua ON ua.id = q.a JOIN u ub ON ub.id = q.b JOIN u uc ON uc.id = q.c),
s AS (SELECT q, section, d, id, round(list_dot_product(u, t), 9) AS score FROM t, u WHERE id NOT IN (a, b, c)),
f AS (SELECT q, section, d, arg_min(id, (-score, id)) AS found, max(score) AS score FROM s WHERE score > 0 GROUP BY ALL) """


def analogy(t):
    q = vecs(t).where("id % 20 = 0").select(F.col("id").alias("q"), F.col("id").alias("a"), *[(F.col("id") + i).alias(x) for i, x in enumerate("bcd", 1)], F.expr("id div 100").alias("section"))
    return N.analogies(q, vecs(t))


@query(ANALOGY + "SELECT q, section, d, found, round(score, 6) AS score FROM f")
def analogy_top1(t):
    return analogy(t).withColumn("score", F.round("score", 6))


@query(ANALOGY + "SELECT section, count(*) AS n, count(*) FILTER (found = d) AS good, round(avg(CAST(found = d AS INT)), 6) AS accuracy, section < 5 AS semantic FROM f GROUP BY section")
def analogy_accuracy(t):
    good = (F.col("found") == F.col("d")).cast("int")
    return analogy(t).groupBy("section").agg(F.count("*").alias("n"), F.sum(good).alias("good"), F.round(F.avg(good), 6).alias("accuracy"), (F.first("section") < 5).alias("semantic"))


@query(LISTS + "SELECT round(avg(rr), 6) AS mrr FROM (SELECT query, coalesce(1 / min(rank) FILTER (rel > 0), 0) AS rr FROM l GROUP BY query)")
def mrr(t):
    return R.reciprocal_rank(lists(t)).agg(F.round(F.avg("rr"), 6).alias("mrr"))


@query(LISTS + ", m AS (SELECT *, max(rank) FILTER (rel > 0) OVER (PARTITION BY query) AS z FROM l) SELECT query, round(coalesce(avg(rel) FILTER (rank <= z), 0), 6) AS r_precision FROM m GROUP BY query")
def r_precision(t):
    return R.r_precision(lists(t)).select("query", F.round("r_precision", 6).alias("r_precision"))


@query(LISTS + "SELECT query, count(*) FILTER (rel > 0 AND rank <= 5) / 5 AS precision FROM l GROUP BY query")
def precision_at_5(t):
    return R.precision_at(lists(t), 5)


AP = LISTS + ", h AS (SELECT *, sum(rel) OVER (PARTITION BY query ORDER BY rank) AS h FROM l), ap AS (SELECT query, coalesce(avg(h / rank) FILTER (rel > 0), 0) AS ap FROM h GROUP BY query) "


@query(AP + "SELECT query, round(ap, 6) AS ap FROM ap")
def average_precision(t):
    return R.average_precision(lists(t)).select("query", F.round("ap", 6).alias("ap"))


@query(AP + "SELECT round(avg(ap), 6) AS map FROM ap")
def mean_average_precision(t):
    return R.average_precision(lists(t)).agg(F.round(F.avg("ap"), 6).alias("map"))


@query(LISTS + "SELECT query, round(sum(CASE WHEN rank = 1 THEN rel ELSE rel / log2(rank) END), 6) AS dcg FROM l GROUP BY query")
def dcg_at_10(t):
    return R.dcg(lists(t), 10).select("query", F.round("dcg", 6).alias("dcg"))


@query(LISTS + """, b AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rel DESC, rank) AS best FROM l), z AS (SELECT query, sum(rel / log2(rank + 1)) AS d, sum(rel / log2(best + 1)) AS i FROM b GROUP BY query)
  SELECT query, round(CASE WHEN i > 0 THEN d / i ELSE 0 END, 6) AS ndcg FROM z""")
def ndcg_at_10(t):
    return R.ndcg(lists(t), 10, 1).select("query", F.round("ndcg", 6).alias("ndcg"))


@query(LISTS + "SELECT query, coalesce(bool_or(rel > 0 AND rank <= 3), false) AS hit FROM l GROUP BY query")
def hit_at_3(t):
    return R.hits(lists(t).withColumn("good", F.col("rel") > 0), 3)


@query(LISTS + "SELECT query, coalesce(min(rank) FILTER (rel > 0), 11) AS best FROM l GROUP BY query")
def mean_rank(t):
    return R.best_rank(lists(t).withColumn("good", F.col("rel") > 0), 10)


@query(LISTS + "SELECT round(sum(rel) / count(*), 6) AS micro, (SELECT round(avg(a), 6) FROM (SELECT avg(rel) AS a FROM l GROUP BY query)) AS macro FROM l")
def micro_macro(t):
    out = R.precisions(lists(t).select(F.col("query").alias("doc"), (F.col("rel") > 0).alias("good")))
    return out.select(F.round("micro", 6).alias("micro"), F.round("macro", 6).alias("macro"))


@query("""WITH r AS (SELECT l_returnflag AS g, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS x,
  rank() OVER (PARTITION BY l_returnflag ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_returnflag, l_discount) - 1) / 2 AS y FROM lineitem) SELECT g, round(corr(x, y), 6) AS rho FROM r GROUP BY g""")
def spearman(t):
    return R.spearman(t("lineitem").withColumnRenamed("l_returnflag", "g"), "g", "l_quantity", "l_discount").select("g", F.round("rho", 6).alias("rho"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_k_largest(t):
    return R.top(t("orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 20, tie="o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 20")
def top_k_smallest(t):
    return R.top(t("orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 20, False, "o_orderkey")


@query("SELECT o_custkey, arg_min(o_orderkey, (-o_totalprice, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def argmax_per_group(t):
    return R.first_in_group(t("orders"), ["o_custkey"], "o_totalprice", "o_orderkey").select("o_custkey", "o_orderkey")
