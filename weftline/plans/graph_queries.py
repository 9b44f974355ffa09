"""Queries on dictionaries, links, candidates, priors and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import graph as G
from weftline.operators import windows as W

from .base import query

#: Anchors of pages: [[/X|Y]] as <a href="/X">Y</a>.
ANCHORS = r"""a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="/([^"]*)">([^<]*)</a>', 1)) AS entity, unnest(regexp_extract_all(html, '<a href="/([^"]*)">([^<]*)</a>', 2)) AS mention FROM pages)"""


def page_anchors_of(t):
    p = F.lit('<a href="/([^"]*)">([^<]*)</a>')
    both = F.arrays_zip(F.regexp_extract_all("html", p, 1).alias("entity"), F.regexp_extract_all("html", p, 2).alias("mention"))
    return t("pages").select("page_id", F.explode(both).alias("a")).select("page_id", "a.entity", "a.mention")


@query("WITH " + ANCHORS + " SELECT * FROM a")
def page_anchors(t):
    return page_anchors_of(t)


def redirects_of(t):
    """Nations redirect to their region's name; regions stand for themselves."""
    return t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("from"), F.col("r_name").alias("to"))


RED = "r AS (SELECT n_name AS f, r_name AS t FROM nation JOIN region ON n_regionkey = r_regionkey)"


@query("WITH " + RED + " SELECT c_custkey, coalesce(r.t, n_name) AS title FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN r ON r.f = n_name AND n_nationkey % 2 = 0")
def redirect_resolve(t):
    even = redirects_of(t).join(t("nation").where("n_nationkey % 2 = 0").select(F.col("n_name").alias("from")), "from", "left_semi")
    links = t("customer").join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("title"))
    return G.resolve(links, "title", even)


@query("WITH " + RED + """, d AS (SELECT r_name AS title, r_regionkey AS id FROM region), l AS (SELECT DISTINCT cn.n_name AS src, sn.n_name AS dst FROM customer JOIN nation cn ON c_nationkey = cn.n_nationkey, supplier JOIN nation sn ON s_nationkey = sn.n_nationkey)
  SELECT DISTINCT a.id AS src, b.id AS dst FROM l JOIN r x ON x.f = src JOIN r y ON y.f = dst JOIN d a ON a.title = x.t JOIN d b ON b.title = y.t""")
def outlinks(t):
    n = t("nation")
    src = t("customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("src")).distinct()
    dst = t("supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("dst")).distinct()
    return G.outlinks(src.join(F.broadcast(dst)), redirects_of(t), t("region").select(F.col("r_name").alias("title"), F.col("r_regionkey").alias("id")))


@query("""WITH p AS (SELECT n_name AS f, CASE WHEN n_nationkey % 3 = 0 THEN n_name ELSE r_name END AS t FROM nation JOIN region ON n_regionkey = r_regionkey)
  SELECT f AS "from", t AS "to" FROM p WHERE f <> t AND t IN (SELECT r_name FROM region)""")
def clean_redirects(t):
    j = t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    pairs = j.select(F.col("n_name").alias("from"), F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name")).otherwise(F.col("r_name")).alias("to"))
    titles = t("region").select(F.col("r_name").alias("title")).union(t("nation").select("n_name"))
    return G.clean_redirects(pairs, titles)[0]


@query("""WITH t AS (SELECT DISTINCT c_mktsegment AS title FROM customer UNION SELECT DISTINCT lower(p_type) FROM part WHERE p_partkey % 2 = 0 UNION SELECT DISTINCT p_type FROM part),
  l AS (SELECT lower(title) AS f, count(*) AS n, min(title) AS t FROM t GROUP BY 1) SELECT f AS "from", t AS "to" FROM l WHERE n = 1 AND f <> t AND f NOT IN (SELECT title FROM t)""")
def casefold_redirects(t):
    p = t("part")
    titles = t("customer").select(F.col("c_mktsegment").alias("title")).union(p.where("p_partkey % 2 = 0").select(F.lower("p_type"))).union(p.select("p_type")).distinct()
    return G.casefold_redirects(titles, t.spark.createDataFrame([], "from string, to string"))


@query("""WITH f AS (SELECT 0 AS o, c_name AS en, CASE WHEN c_custkey % 2 = 0 THEN 'z' || c_custkey END AS zh, NULL AS es FROM customer UNION ALL SELECT 1, CASE WHEN c_custkey % 3 > 0 THEN c_name END, 'y' || c_custkey, 'e' || c_custkey FROM customer),
  k AS (SELECT *, coalesce('en:' || en, 'zh:' || zh, 'es:' || es) AS k FROM f)
  SELECT arg_min(en, o) AS en, arg_min(zh, o) AS zh, arg_min(es, o) AS es FROM k GROUP BY k""")
def cross_links_merge(t):
    c = t("customer")
    one = c.select(F.col("c_name").alias("en"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("z"), "c_custkey")).alias("zh"), F.lit(None).cast("string").alias("es"))
    two = c.select(F.when(F.col("c_custkey") % 3 > 0, F.col("c_name")).alias("en"), F.concat(F.lit("y"), "c_custkey").alias("zh"), F.concat(F.lit("e"), "c_custkey").alias("es"))
    return G.merge_links([one, two], ("en", "zh", "es"))


@query("SELECT CASE WHEN c_custkey % 2 = 0 THEN c_name END AS en, 'z' || c_custkey AS zh FROM customer WHERE c_custkey % 2 = 0")
def cross_links_subset(t):
    c = t("customer").select(F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("en"), F.concat(F.lit("z"), "c_custkey").alias("zh"), F.lit(None).cast("string").alias("es"))
    return G.sub_links(c, ("en", "zh"))


@query("""WITH p AS (SELECT o_orderkey AS n, o_custkey AS a, o_orderkey % 100 AS b FROM orders), k AS (SELECT * FROM p WHERE a % 2 = 0 AND b < 80), g AS (SELECT a, min(n) AS n, arg_max(b, n) AS b FROM k GROUP BY a)
  SELECT row_number() OVER (ORDER BY n) - 1 AS slot, a, b FROM g""")
def cross_link_slots(t):
    pairs = t("orders").select(F.col("o_orderkey").alias("n"), F.col("o_custkey").alias("a"), (F.col("o_orderkey") % 100).alias("b"))
    first = t("customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("item"))
    out = G.link_slots(pairs, first, t.spark.range(80).withColumnRenamed("id", "item"))
    return out.select(F.col("slot").cast("long").alias("slot"), "a", "b")


@query("""WITH x AS (SELECT DISTINCT c_nationkey AS article, c_custkey AS entity FROM customer), y AS (SELECT s_nationkey AS article, s_suppkey AS entity FROM supplier)
  SELECT x.article AS article1, x.entity AS entity1, y.article AS article2, y.entity AS entity2 FROM x JOIN y ON y.article = x.article AND y.entity = x.entity % 10 + 1""")
def parallel_pairs(t):
    left = t("customer").select(F.col("c_nationkey").cast("long").alias("article"), F.col("c_custkey").alias("entity"), F.col("c_name").alias("context"))
    right = t("supplier").select(F.col("s_nationkey").cast("long").alias("article"), (F.col("s_suppkey") + 1000000).alias("entity"), F.col("s_name").alias("context"))
    same = t("nation").select(F.col("n_nationkey").cast("long").alias("a"), F.col("n_nationkey").cast("long").alias("b"))
    ents = t("customer").where("c_custkey > 25").select(F.col("c_custkey").alias("a"), (F.col("c_custkey") % 10 + 1000001).alias("b"))
    low = t("customer").where("c_custkey <= 25").select(F.col("c_custkey").alias("a"), (F.col("c_custkey") % 10 + 1000001).alias("b"))
    out = G.parallel_pairs(left, right, same.union(ents).union(low))
    return out.select("article1", "entity1", "article2", (F.col("entity2") - 1000000).alias("entity2"))


def brands(t):
    return t("part").select(F.col("p_brand").alias("mention"), F.col("p_partkey").cast("string").alias("entity"))


@query("""WITH s AS (SELECT p_brand AS mention, CAST(p_partkey AS VARCHAR) AS entity FROM part UNION SELECT p_type, CAST(p_partkey AS VARCHAR) FROM part) SELECT * FROM s WHERE mention IN (SELECT p_brand FROM part WHERE p_partkey % 7 = 0 UNION SELECT p_type FROM part WHERE p_partkey % 7 = 1)""")
def candidates(t):
    p = t("part")
    asked = p.where("p_partkey % 7 = 0").select(F.col("p_brand").alias("mention")).union(p.where("p_partkey % 7 = 1").select("p_type"))
    return G.candidates(asked, [brands(t), p.select(F.col("p_type").alias("mention"), F.col("p_partkey").cast("string").alias("entity"))])


@query("SELECT p_brand AS mention, CAST(p_partkey AS VARCHAR) AS entity, CASE WHEN p_partkey % 2 = 0 THEN 'l' || p_partkey ELSE '' END AS linked FROM part")
def candidate_links(t):
    links = t("part").where("p_partkey % 2 = 0").select(F.col("p_partkey").cast("string").alias("a"), F.concat(F.lit("l"), "p_partkey").alias("b"))
    return G.with_links(brands(t), links).select("mention", "entity", "linked")


@query("SELECT DISTINCT 'x' || p_brand AS mention, CAST(p_partkey AS VARCHAR) AS entity FROM part")
def candidate_translation(t):
    b = brands(t)
    words = b.select("mention").distinct().select(F.concat(F.lit("x"), "mention").alias("mention"), F.col("mention").alias("english"))
    return G.translated(b, words)


@query("SELECT DISTINCT lower(p_name) AS mention, p_partkey AS entity FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 2 = 0")
def title_candidates(t):
    p = t("part")
    return G.title_candidates(p.select(F.col("p_name").alias("title"), F.col("p_partkey").alias("id")), p.where("p_partkey % 3 = 0").select(F.lower("p_name").alias("mention")).union(t.spark.createDataFrame([("none",)], "mention string")), p.where("p_partkey % 2 = 0 and p_partkey % 3 = 0").select(F.col("p_partkey").alias("entity")))


@query("""WITH c AS (SELECT l_orderkey AS mention_id, l_partkey AS entity FROM lineitem WHERE l_partkey % 5 <> 0), g AS (SELECT l_orderkey AS mention_id, min(l_partkey) AS gold FROM lineitem GROUP BY 1)
  SELECT c.mention_id, c.entity, g.gold FROM c JOIN g USING (mention_id) WHERE g.gold % 5 <> 0""")
def gold_filter(t):
    li = t("lineitem")
    cands = li.select(F.col("l_orderkey").alias("mention_id"), F.col("l_partkey").alias("entity"))
    gold = li.groupBy(F.col("l_orderkey").alias("mention_id")).agg(F.min("l_partkey").alias("entity"))
    vectors = t("part").where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("entity"))
    return G.with_gold(cands, gold, vectors).select("mention_id", "entity", "gold")


@query("""WITH c AS (SELECT p_brand AS mention, list(DISTINCT p_partkey) AS c FROM part WHERE p_size > 10 GROUP BY 1) SELECT substr(p_type, 1, 3) AS g, count(*) AS n, count(c.c) AS with_candidates, count(*) FILTER (list_contains(c.c, p_partkey)) AS with_gold
  FROM part LEFT JOIN c ON c.mention = p_brand GROUP BY 1""")
def coverage(t):
    p = t("part")
    m = p.select(F.col("p_brand").alias("mention"), F.col("p_partkey").alias("entity"), "p_type")
    return G.coverage(m, p.where("p_size > 10").select(F.col("p_brand").alias("mention"), F.col("p_partkey").alias("entity")), F.substring("p_type", 1, 3))


COUNTED = "c AS (SELECT l_partkey AS entity, p_brand AS mention, count(*) AS cnt FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"


def counted(t):
    j = t("lineitem").groupBy(F.col("l_partkey").alias("entity")).agg(F.count("*").alias("cnt"))
    return j.join(t("part").select(F.col("p_partkey").alias("entity"), F.col("p_brand").alias("mention")), "entity")


@query("WITH " + COUNTED + " SELECT entity, mention, cnt FROM c")
def mention_counts(t):
    return counted(t).select("entity", "mention", "cnt")


@query("WITH " + COUNTED + " SELECT entity, mention, round(cnt / sum(cnt) OVER (PARTITION BY mention), 6) AS pem, round(sum(cnt) OVER (PARTITION BY entity) / sum(cnt) OVER () * 100, 6) AS pe FROM c")
def mention_prior(t):
    return G.priors(counted(t)).select("entity", "mention", F.round("pem", 6).alias("pem"), F.round("pe", 6).alias("pe"))


@query("WITH " + COUNTED + ", p AS (SELECT *, cnt / sum(cnt) OVER (PARTITION BY mention) AS pem FROM c) SELECT mention, entity FROM p WHERE pem > 0.98 UNION ALL SELECT mention, entity FROM (SELECT mention, entity, max(pem) OVER (PARTITION BY mention) AS m FROM p) WHERE m <= 0.98")
def confident_candidates(t):
    from weftline.operators.linking import short_circuit

    return short_circuit(G.priors(counted(t)), "mention", "pem").select("mention", "entity")


@query("""WITH g AS (SELECT o_custkey AS k, list(o_orderkey ORDER BY o_orderkey) FILTER (o_orderkey % 3 = 0) AS f, list(o_orderkey ORDER BY o_orderkey) FILTER (o_orderkey % 3 > 0) AS s FROM orders GROUP BY 1),
  p AS (SELECT k, CASE WHEN len(f) > len(s) THEN s ELSE f END AS s, CASE WHEN len(f) > len(s) THEN f ELSE s END AS l FROM g WHERE f IS NOT NULL AND s IS NOT NULL), r AS (SELECT *, greatest(len(l) // len(s), 1) AS r FROM p),
  m AS (SELECT k, flatten(list_transform(range(len(s)), lambda i: list_concat([s[i + 1]], l[i * r + 1:(i + 1) * r]))) AS m FROM r) SELECT k AS key, unnest(range(len(m))) AS i, unnest(m) AS value FROM m""")
def interleave(t):
    o = t("orders")
    some = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("o_orderkey"))))
    p = o.groupBy(F.col("o_custkey").alias("key")).agg(some(F.col("o_orderkey") % 3 == 0).alias("first"), some(F.col("o_orderkey") % 3 > 0).alias("second"))
    return G.interleaved(p.where("size(first) > 0 and size(second) > 0")).select("key", F.col("i").cast("long").alias("i"), "value")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') ORDER BY o_orderkey LIMIT 50")
def sample_first_n(t):
    some = t("customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return t("orders").join(some, "o_custkey", "left_semi").orderBy("o_orderkey").limit(50).select("o_orderkey", "o_totalprice")


SEQ = "s AS (SELECT user_id, list(event_type ORDER BY event_id) AS t FROM events GROUP BY 1), e AS (SELECT user_id, t, unnest(range(len(t))) AS i FROM s)"


def sequences(t):
    return t("events").groupBy("user_id").agg(F.expr("transform(array_sort(collect_list(struct(event_id, event_type))), x -> x.event_type)").alias("t"))


@query("WITH " + SEQ + ", p AS (SELECT t[i + 1] AS centre, unnest(list_concat(t[greatest(i - 2, 0) + 1:i], t[i + 2:i + 3])) AS context FROM e) SELECT centre, context, count(*) AS n FROM p GROUP BY ALL")
def skipgram_pairs(t):
    return W.skipgrams(sequences(t), "user_id", "t", 2).groupBy("centre", "context").agg(F.count("*").alias("n"))


@query("WITH " + SEQ + " SELECT user_id, i, list_concat(t[greatest(i - 3, 0) + 1:i], t[i + 2:i + 4]) AS ctx FROM e")
def anchor_window(t):
    e = sequences(t).select("user_id", "t", F.posexplode("t").alias("i", "_"))
    return e.select("user_id", F.col("i").cast("long").alias("i"), W.around("t", "i", "1", 3).alias("ctx"))


@query("WITH " + SEQ + " SELECT user_id, i, t[greatest(i - 3, 0) + 1:i + 5] AS ctx FROM e")
def context_with_mention(t):
    e = sequences(t).select("user_id", "t", F.posexplode("t").alias("i", "_"))
    return e.select("user_id", F.col("i").cast("long").alias("i"), W.around("t", "i", "1", 3, 1, True).alias("ctx"))


@query("WITH " + SEQ + " SELECT user_id, i, list_concat(t[greatest(i - 5, 0) + 1:i], t[i + 2:i + 5]) AS ctx FROM e")
def scws_window(t):
    e = sequences(t).select("user_id", "t", F.posexplode("t").alias("i", "_"))
    return e.select("user_id", F.col("i").cast("long").alias("i"), F.expr("concat(slice(t, greatest(i - 5, 0) + 1, least(i, 5)), slice(t, i + 2, 4))").alias("ctx"))


@query("SELECT DISTINCT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier")
def key_difference(t):
    return t("customer").select(F.col("c_nationkey").alias("k")).distinct().join(t("supplier").select(F.col("s_nationkey").alias("k")), "k", "left_anti")


@query("SELECT DISTINCT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def key_intersection(t):
    return t("customer").select(F.col("c_nationkey").alias("k")).intersect(t("supplier").select(F.col("s_nationkey").alias("k")))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier UNION SELECT n_nationkey FROM nation")
def key_union(t):
    return t("customer").select(F.col("c_nationkey").alias("k")).union(t("supplier").select("s_nationkey")).union(t("nation").select("n_nationkey")).distinct()
