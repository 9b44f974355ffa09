"""Queries on evaluation sets, their readers, writers, and pairs to train on."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import vectors as V
from weftline.operators import evaluation as X
from weftline.operators import graph as G
from weftline.operators import linking as K
from weftline.operators import training as T
from weftline.operators import windows as W
from weftline.sources import files as S
from weftline.sources import lines as L

from .base import query
from .vector_queries import E_, KNN, found, vecs

TAB = "\t"


@query("WITH " + E_ + """, p AS (SELECT q.id AS query, c.id AS cand, CAST(q.label = c.label AS INT) AS rel, round(list_dot_product(q.v, c.v), 9) AS s, count(*) OVER (PARTITION BY q.id) AS n FROM e q JOIN e c ON c.id BETWEEN q.id + 1 AND q.id + 30),
  r AS (SELECT query, rel, row_number() OVER (PARTITION BY query ORDER BY s DESC, CAST(cand AS VARCHAR)) AS k FROM p WHERE n > 1),
  i AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rel DESC, k) AS b, sum(rel) OVER (PARTITION BY query ORDER BY k) AS h FROM r),
  g AS (SELECT query, rel, k, b, h, CASE WHEN k = 1 THEN rel ELSE rel / log2(k) END AS x, CASE WHEN b = 1 THEN rel ELSE rel / log2(b) END AS y FROM i)
  SELECT CAST(query AS VARCHAR) AS query, round(coalesce(avg(h / k) FILTER (rel > 0), 0), 9) AS ap, """ + ", ".join(f"round(CASE WHEN sum(y) FILTER (b <= {k}) > 0 THEN sum(x) FILTER (k <= {k}) / sum(y) FILTER (b <= {k}) ELSE 0 END, 9) AS ndcg_{k}" for k in (1, 5, 10)) + " FROM g GROUP BY query")
def entity_relatedness(t):
    e = vecs(t)
    pairs = e.select(F.col("id").alias("q"), F.col("label").alias("l"), F.explode(F.sequence(F.col("id") + 1, F.col("id") + 30)).alias("c"))
    pairs = pairs.join(e.select(F.col("id").alias("c"), F.col("label").alias("m")), "c")
    lines = pairs.select(F.concat_ws(TAB, F.col("q").cast("string"), F.col("c").cast("string"), (F.col("l") == F.col("m")).cast("int").cast("string")).alias("value"))
    out = X.relatedness(L.related_pairs(lines, e), e.select(F.col("id").cast("string").alias("id"), "vec"))
    return out.select("query", *[F.round(c, 9).alias(c) for c in out.columns if c != "query"])


TRANSLATED = KNN + """, x AS (SELECT id AS q, unnest(['class' || (id // 20) % 10, 'class' || (id // 20 + 3) % 10]) AS w FROM e WHERE id % 20 = 0),
b AS (SELECT x.q AS query, coalesce(min(rank), 11) AS best FROM x LEFT JOIN k ON k.q = x.q AND rank <= 10 AND 'class' || rl = x.w GROUP BY x.q)"""


def translations(t):
    f = found(t).join(vecs(t).select("id", F.concat(F.lit("Class"), "label").alias("label")), "id").select(F.col("q").alias("query"), "label", "rank")
    word = lambda k: F.concat(F.lit("CLASS"), ((F.floor(F.col("id") / 20) + k) % 10).cast("string"))
    lexicon = vecs(t).where("id % 20 = 0").select(F.col("id").alias("query"), F.explode(F.array(word(0), word(3))).alias("translation"))
    return X.translation_ranks(f, lexicon, 10, 5)


@query("WITH " + TRANSLATED + " SELECT query, CAST(best AS BIGINT) AS best, CAST(best <= 5 AS INT) AS hit FROM b")
def translation_hits(t):
    return translations(t)


@query("WITH " + TRANSLATED + " SELECT avg(best) AS mean_rank, avg(CAST(best <= 5 AS INT)) AS hits FROM b")
def translation_mean_rank(t):
    return translations(t).agg(F.avg("best").alias("mean_rank"), F.avg("hit").alias("hits"))


@query("WITH " + E_ + """, p AS (SELECT p_partkey AS id, unnest(['w' || p_partkey, 'w' || (p_partkey + 1)]) AS w, 1 AS side FROM part UNION ALL SELECT p_partkey, unnest(['w' || (p_partkey + 2), 'zzz']), 2 FROM part),
  m AS (SELECT p.id, side, i, avg(v[i]) AS x FROM p JOIN e ON 'w' || e.id = w, range(1, 65) r(i) GROUP BY p.id, side, i),
  f AS (SELECT id, side, list(x ORDER BY i) AS v FROM m GROUP BY id, side)
  SELECT p_partkey AS id, round(CASE WHEN a.v IS NOT NULL AND b.v IS NOT NULL THEN (list_cosine_similarity(a.v, b.v) + 1) / 2 ELSE 0.5 END, 9) AS similarity FROM part LEFT JOIN f a ON a.id = p_partkey AND a.side = 1 LEFT JOIN f b ON b.id = p_partkey AND b.side = 2""")
def phrase_similarity(t):
    w = lambda k: F.concat(F.lit("W"), (F.col("p_partkey") + k).cast("string"))
    lines = t("part").select(F.col("p_partkey").alias("n"), F.concat(w(0), F.lit(" "), w(1), F.lit(TAB), w(2), F.lit(" zzz")).alias("value"))
    pairs = L.phrase_pairs(lines).withColumnRenamed("n", "id")
    out = X.pair_similarity(pairs, vecs(t).select(F.concat(F.lit("w"), "id").alias("label"), "vec"), 64)
    return out.select("id", F.round("similarity", 9).alias("similarity"))


SENSES = "s AS (SELECT id // 6 AS pair, CASE WHEN id % 6 < 3 THEN 1 ELSE 2 END AS side, id AS sense, (id % 5 + 1) / 10 AS weight, v FROM e)"


@query("WITH " + E_ + ", " + SENSES + """, b AS (SELECT a.pair, (list_cosine_similarity(a.v, b.v) + 1) / 2 AS s, a.weight * b.weight AS w, row_number() OVER (PARTITION BY a.pair ORDER BY a.weight DESC, b.weight DESC, a.sense DESC, b.sense DESC) AS k
  FROM s a JOIN s b ON a.pair = b.pair AND a.side = 1 AND b.side = 2) SELECT pair, round(sum(s * w) / sum(w), 9) AS avg_sim, round(max(s) FILTER (k = 1), 9) AS max_sim FROM b GROUP BY pair""")
def sense_similarity(t):
    s = vecs(t).select(F.expr("id div 6").alias("pair"), F.when(F.col("id") % 6 < 3, 1).otherwise(2).alias("side"), F.col("id").alias("sense"), ((F.col("id") % 5 + 1) / 10).alias("weight"), "vec")
    return X.sense_similarity(s).select("pair", F.round("avg_sim", 9).alias("avg_sim"), F.round("max_sim", 9).alias("max_sim"))


@query("SELECT p_partkey AS n, lower(p_name) AS w1, lower(p_brand) AS w2, p_retailprice AS score FROM part WHERE p_partkey >= 11")
def wordsim_reader(t):
    line = F.concat_ws(TAB, F.lit("x"), "p_name", "p_brand", F.col("p_retailprice").cast("string"))
    return L.similarity_pairs(t("part").select(F.col("p_partkey").alias("n"), line.alias("value")))


@query("SELECT p_partkey AS n, 'a <b> ' || lower(p_brand) || ' </b> c' AS context1, 'd <b>' || lower(p_mfgr) || '</b>' AS context2, lower(p_brand) AS w1, p_mfgr || '</b>' AS w2, CAST(p_size AS DOUBLE) AS score FROM (SELECT *, 'm' || p_size AS p_mfgr FROM part)")
def scws_reader(t):
    one, two = F.concat(F.lit("A <b> "), "p_brand", F.lit(" </b> c")), F.concat(F.lit("d <b>M"), F.col("p_size").cast("string"), F.lit("</b>"))
    line = F.concat_ws(TAB, *[F.lit(str(k)) for k in range(5)], one, two, F.col("p_size").cast("string"))
    return L.context_pairs(t("part").select(F.col("p_partkey").alias("n"), line.alias("value")))


@query("SELECT conv_id AS doc, turn * 100 AS start, text FROM (SELECT conv_id, turn, 'turn ' || turn || ' of ' || role AS text FROM conversations) WHERE turn >= 0")
def kbp_xml_segments(t):
    seg = lambda start, text: F.concat(F.lit('<SEG start_char="'), start.cast("string"), F.lit('"><ORIGINAL_TEXT>'), text, F.lit("</ORIGINAL_TEXT></SEG>"))
    text = F.concat(F.lit("turn "), F.col("turn").cast("string"), F.lit(" of "), "role")
    odd = F.concat(seg(F.lit(1), F.lit("&lt;post a=1&gt;")), seg(F.lit(2), F.lit("Source: x")), seg(F.lit(3), F.lit("TIME: 1")))
    each = t("conversations").groupBy("conv_id").agg(F.concat_ws("", F.collect_list(seg(F.col("turn") * 100 + 40, text))).alias("x"))
    return L.kbp_xml(each.select(F.col("conv_id").alias("doc"), F.concat(F.lit("<DOC><TEXT>"), odd, "x", F.lit("</TEXT></DOC>")).alias("value")))


@query("SELECT 'corp/' || lang || '/d' || doc_id || '.xml' AS file, 'd' || doc_id AS doc FROM documents JOIN labels USING (doc_id)")
def corpus_scan(t):
    doc = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    lines = t("documents").select(F.concat(F.lit("corp/"), "lang", F.lit("/"), doc, F.lit(".xml")).alias("file"), F.col("text").alias("value"))
    return L.corpus_files(lines, t("labels").select(doc.alias("doc"))).select("file", "doc")


@query("SELECT 'm.0' || page_id AS kb_id, page_id AS wiki_id FROM pages WHERE page_id IN (SELECT doc_id FROM labels)")
def rdf_link_scan(t):
    line = lambda p: F.concat(F.lit("<http://k.b/ns/m.0"), F.col("page_id").cast("string"), F.lit(f"> <http://k.b/ns/type.key/{p}> \""), F.col("page_id").cast("string"), F.lit("\"@en ."))
    lines = t("pages").select(F.explode(F.array(line("wikipedia.en_id"), line("other"))).alias("value"))
    return L.rdf_links(lines, r"/wikipedia\.en_id", t("labels").select(F.col("doc_id").alias("wiki_id")).distinct())


@query("""WITH l AS (SELECT n_name AS en, CASE WHEN n_nationkey % 2 = 0 THEN 'z' || n_name END AS zh FROM nation)
  SELECT 0 AS n, CAST(count(*) AS VARCHAR) AS value FROM l UNION ALL SELECT 1, 'en' || chr(9) || 'zh' UNION ALL SELECT 2, en || chr(9) || coalesce(zh, '') FROM l""")
def cross_link_writer(t):
    links = t("nation").select(F.col("n_name").alias("en"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("z"), "n_name")).alias("zh"))
    return S.cross_link_lines(links, ("en", "zh"))


@query("SELECT event_id || ',' || user_id || ',' || event_type || ',' || coalesce(props, '') AS value FROM events")
def feature_csv_writer(t):
    return S.csv_lines(t("events"), "event_id", "user_id", "event_type", "props")


@query("SELECT c_name || chr(9) || string_agg(DISTINCT o_orderpriority, chr(9) ORDER BY o_orderpriority) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_name")
def candidate_writer(t):
    j = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return S.candidate_lines(j.select(F.col("c_name").alias("mention"), F.col("o_orderpriority").alias("entity")))


@query(r"SELECT o_custkey AS pair, string_agg(o_orderstatus || '(' || format('{:.5f}', o_orderkey % 7 / 8) || '\' || format('{:.5f}', o_orderkey % 5 / 4) || '\' || format('{:.5f}', (o_orderkey % 7 / 8) * (o_orderkey % 5 / 4)) || ')', ' ' ORDER BY o_orderkey) AS value FROM orders GROUP BY o_custkey")
def attention_dump(t):
    kg, w = F.col("o_orderkey") % 7 / 8, F.col("o_orderkey") % 5 / 4
    return S.attention_lines(t("orders").select(F.col("o_custkey").alias("pair"), F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("word"), kg.alias("kg"), w.alias("w"), (kg * w).alias("combined")))


@query("""WITH d AS (SELECT doc_id, coalesce(length(text), 0) AS n FROM documents), b AS (SELECT doc_id, CAST(coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM d), f AS (SELECT *, before // 20000 AS f FROM b)
  SELECT doc_id, before, chr(CAST(65 + f // 2600 % 26 AS INT)) || chr(CAST(65 + f // 100 % 26 AS INT)) || '/wiki_' || lpad(CAST(f % 100 AS VARCHAR), 2, '0') AS path FROM f""")
def size_split_output(t):
    sizes = t("documents").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n"))
    return S.output_files(sizes, "doc_id", "n", 20_000).select("doc_id", "before", "path")


@query("SELECT substring(c_name, 1, 3) AS lang, o_orderpriority AS mention, CAST(list_sort(list(DISTINCT o_orderstatus)) AS VARCHAR) AS entities FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2")
def gold_dictionary(t):
    j = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_name").alias("doc"), F.col("o_orderpriority").alias("mention"), F.col("o_orderstatus").alias("entity"))
    out = G.gold_dictionary(j, F.substring("doc", 1, 3))
    return out.withColumn("entities", F.concat(F.lit("["), F.concat_ws(", ", "entities"), F.lit("]")))


@query("SELECT count(*) AS mentions, CAST(sum(n) AS BIGINT) AS candidates FROM (SELECT p_type, count(DISTINCT p_brand) AS n FROM part GROUP BY p_type)")
def candidate_totals(t):
    return G.candidate_totals(t("part").select(F.col("p_type").alias("mention"), F.col("p_brand").alias("entity")))


@query("SELECT DISTINCT lower(n_name) AS mention, r_regionkey AS entity FROM nation JOIN region ON n_regionkey = r_regionkey")
def redirect_candidates(t):
    pairs = t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("from"), F.col("r_name").alias("to"))
    return G.redirect_candidates(pairs, t("region").select(F.col("r_name").alias("title"), F.col("r_regionkey").alias("id")))


@query(r"SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title FROM pages WHERE regexp_extract(html, '<title>(.*?)</title>', 1) IN (SELECT regexp_extract(html, '<title>(.*?)</title>', 1) FROM pages WHERE page_id % 3 = 0)")
def subset_extractor(t):
    p = t("pages").select("page_id", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"))
    return G.linked_pages(p, p.where("page_id % 3 = 0"))


@query("SELECT role AS lang, count(*) FILTER (len(text) > 0 AND turn % 2 = 1) AS n FROM conversations GROUP BY role")
def parallel_sizes(t):
    side = lambda c: F.when(c, F.array("text")).otherwise(F.array().cast("array<string>"))
    rows = t("conversations").select(F.col("role").alias("lang"), side(F.length("text") > 0).alias("sentences1"), side(F.col("turn") % 2 == 1).alias("sentences2"))
    return G.paired_sizes(rows)


@query("""WITH s AS (SELECT conv_id, list(role ORDER BY turn) AS r FROM conversations GROUP BY conv_id), x AS (SELECT conv_id, r, unnest(range(len(r))) AS i FROM s)
  SELECT conv_id, i, array_to_string(list_concat(list_concat(r[greatest(i - 2, 0) + 1:i], ['#' || i]), r[i + 2:i + 3]), ' ') AS ctx FROM x WHERE len(r) > 1 AND i % 4 <> 3""")
def context_keeping_anchor(t):
    s = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("r")).select("conv_id", F.col("r.role").alias("r"))
    s = s.select("conv_id", "r", F.posexplode("r").alias("i", "_"))
    anchor = F.when(F.col("i") % 4 != 3, F.concat(F.lit("#"), F.col("i").cast("string")))
    out = s.select("conv_id", F.col("i").cast("long").alias("i"), W.keeping_anchor("r", "i", "1", 2, anchor).alias("ctx")).where("ctx is not null")
    return out.withColumn("ctx", F.concat_ws(" ", "ctx"))


@query("WITH " + E_ + """, c AS (SELECT id // 12 AS doc, id // 3 AS m, id AS entity, v FROM e), p AS (SELECT doc, m, entity, v, row_number() OVER (PARTITION BY doc, m ORDER BY entity * 7 % 11 DESC, entity DESC) AS k FROM c),
  j AS (SELECT c.doc, c.m, c.entity, (list_cosine_similarity(c.v, p.v) + 1) / 2 AS s FROM c LEFT JOIN p ON p.doc = c.doc AND p.k = 1 AND p.m <> c.m)
  SELECT doc, m AS mention_id, entity, round(coalesce(max(s), 0), 9) AS csim_max, round(coalesce(avg(s), 0), 9) AS csim_mean FROM j GROUP BY ALL""")
def second_pass(t):
    c = vecs(t).select(F.expr("id div 12").alias("doc"), F.expr("id div 3").alias("mention_id"), F.col("id").alias("entity"), "vec")
    out = K.second_pass(c, c.select("doc", "mention_id", "entity", (F.col("entity") * 7 % 11).alias("score")))
    return out.select("doc", "mention_id", "entity", F.round("csim_max", 9).alias("csim_max"), F.round("csim_mean", 9).alias("csim_mean"))


@query("WITH c AS (SELECT l_partkey AS id, count(*) AS cn FROM lineitem GROUP BY 1) SELECT id, round(power(cn, 0.75) / sum(power(cn, 0.75)) OVER (), 9) AS p FROM c")
def noise_probabilities(t):
    n = T.noise(t("lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.count("*").alias("cn")))
    return n.select("id", F.round(F.col("high") - F.col("low"), 9).alias("p"))


WINDOWS = "w AS (SELECT o_custkey AS sense, o_orderkey AS o, l_partkey AS word FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"


def windows(t, name):
    """The lines are dealt by order into parts of bounded size, which the join and the lists keep."""
    lines = t("lineitem").select("l_orderkey", "l_partkey")
    j = t("orders").join(lines.repartition(T.parts(t.spark, lines.count()), "l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    return j.groupBy(F.col("o_custkey").alias(name), F.col("o_orderkey").alias("o")).agg(F.collect_list("l_partkey").alias("context"))


@query("WITH " + WINDOWS + ", p AS (SELECT word AS src, sense AS dst FROM w UNION ALL SELECT sense, c_nationkey FROM (SELECT DISTINCT sense, o FROM w) JOIN customer ON c_custkey = sense) SELECT src, dst, count(*) AS n FROM p GROUP BY src, dst")
def sense_training_pairs(t):
    entities = t("customer").select(F.col("c_custkey").alias("sense"), F.col("c_nationkey").cast("long").alias("entity"))
    return T.pair_counts(T.sense_pairs(windows(t, "sense"), entities), t("lineitem").count() + t("orders").count())


@query("WITH " + WINDOWS + ", p AS (SELECT sense AS src, word AS dst FROM w UNION ALL SELECT word, sense FROM w) SELECT src, dst, count(*) AS n FROM p GROUP BY src, dst")
def anchor_alignment_pairs(t):
    return T.pair_counts(T.anchor_pairs(windows(t, "entity")), 2 * t("lineitem").count())


@query("SELECT r * 25 + n_nationkey AS k, n_name FROM nation, range(5) x(r) WHERE r * 25 + n_nationkey < 110")
def recycled_input(t):
    return T.recycled(t("nation").select(F.col("n_nationkey").cast("long").alias("k"), "n_name"), 25, 110)


@query("SELECT doc_id, substring(text, 11, 30) AS part FROM documents")
def sentence_range(t):
    return t("documents").select("doc_id", F.substring("text", 11, 30).alias("part"))


@query(r"""WITH w AS (SELECT unnest(string_split(text, ' ')) AS word FROM documents UNION ALL SELECT unnest(string_split(text, ' ')) FROM conversations) SELECT word, count(*) AS cn FROM w WHERE word <> '' GROUP BY word""")
def merged_vocabulary(t):
    each = t("documents").select("text").union(t("conversations").select("text"))
    return each.select(F.explode(F.split("text", " ")).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("cn"))


@query("WITH " + E_ + """, x AS (SELECT id AS ex, list_value(id, (id + 1) % 500) AS c, (id * 7) % 500 AS dst, id % 2 AS label FROM e WHERE id < 500),
  m AS (SELECT ex, c, dst, label, list(h ORDER BY i) AS h, list(u ORDER BY i) AS u FROM (SELECT ex, c, dst, x.label, i, avg(a.v[i]) AS h, any_value(d.v[i]) AS u FROM x JOIN e a ON list_contains(c, a.id) JOIN e d ON d.id = dst, range(1, 65) r(i) GROUP BY ex, c, dst, x.label, i) GROUP BY ex, c, dst, label),
  g AS (SELECT c, dst, h, u, label - 1 / (1 + exp(-list_dot_product(h, u))) AS e FROM m),
  p AS (SELECT dst AS id, 'out' AS side, i, e * h[i] AS x FROM g, range(1, 65) r(i) UNION ALL SELECT id, 'vec', i, e / 2 * u[i] FROM (SELECT unnest(c) AS id, u, e FROM g), range(1, 65) r(i)),
  s AS (SELECT id, side, i, sum(x) AS x FROM p GROUP BY id, side, i) SELECT id, side, round(sum(x), 8) AS total, round(sum(x * x), 8) AS squares FROM s GROUP BY id, side""")
def cbow_gradients(t):
    """Of vectors that stand for both sides of a model; the gradients' sums and squares."""
    v = vecs(t).select("id", V.doubles(F.col("vec")).alias("vec"), V.doubles(F.col("vec")).alias("out"))
    ex = v.where("id < 500").select(F.col("id").alias("ex"), F.array(F.col("id"), (F.col("id") + 1) % 500).alias("context"), (F.col("id") * 7 % 500).alias("dst"), (F.col("id") % 2).alias("label"))
    g = T.cbow_step(ex, v).select("id", "side", F.explode("gradient").alias("x"))
    return g.groupBy("id", "side").agg(V.rounded(F.sum("x"), 8).alias("total"), F.round(F.sum(F.col("x") * F.col("x")), 8).alias("squares"))


@query()
def train_skipgram_loss(t):
    """Skip-gram with negatives over the whole order-part graph: the mean loss of each epoch."""
    from weftline.functions.paths import scratch

    pairs = t("lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_orderkey") + 1_000_000_000).alias("dst")).distinct()
    counts = pairs.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("cn"))
    ids = pairs.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    config = T.Config(dim=8, alpha=0.1, clip=0)
    _, losses = T.train(pairs, T.initial(ids, 8), config, T.noise(counts), scratch(t.spark, "skipgram"), 3)
    return t.spark.createDataFrame(list(enumerate(losses)), "epoch int, loss double")
