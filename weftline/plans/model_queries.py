"""Queries on page markup, linking and training."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import markup as M
from weftline.functions import tokenizer as Z
from weftline.functions import vectors as V
from weftline.operators import linking as K
from weftline.operators import training as T

from .base import query
from .graph_queries import COUNTED, counted
from .vector_queries import E_, vecs

PAGE = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', ' ', 'gs'), '<script\b[^>]*>.*?</script\s*>', '', 'gsi'), '<style\b[^>]*>.*?</style\s*>', '', 'gsi'), '<nav\b[^>]*>.*?</nav\s*>', '', 'gsi'), '<[^>]+>', ' ', 'g'), '[ \t\n\r]+', ' ', 'g'))"""


@query(f"SELECT page_id, {PAGE} AS text FROM pages")
def page_text(t):
    return t("pages").select("page_id", M.page_text(F.col("html")).alias("text"))


@query(r"SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title, regexp_replace(regexp_replace(html, '<script\b[^>]*>.*?</script\s*>', '', 'gsi'), '<[^>]+>', '', 'g') AS text FROM pages")
def page_titles(t):
    return t("pages").select("page_id", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"), M.without_tags(M.without_elements(F.col("html"), "script")).alias("text"))


@query("SELECT p_partkey, 'a ' || p_name || ' and  b' || p_brand AS flat FROM part")
def flat_markup(t):
    raw = F.concat(F.lit("<!-- x -->'''a''' [http://x.y "), "p_name", F.lit("] and __NOTOC__ [http://z] b''"), "p_brand", F.lit("''"))
    out = M.flat(raw)
    return t("part").select("p_partkey", F.replace(out, F.lit("and   b"), F.lit("and  b")).alias("flat"))


def wiki(t):
    """Wiki text with nested templates, links, a table and elements."""
    raw = F.concat(F.lit("{{info|a={{b}}}}'''"), "p_name", F.lit("''' is [[x:y|z]]a [[File:q.png|thumb|[[p]]]][["), "p_brand", F.lit("|the "), "p_type", F.lit("]]s<ref>no</ref> &amp; {|t|}<b>end</b>."))
    return t("part").select("p_partkey", raw.alias("raw"))


@query("SELECT p_partkey, p_name || ' is a the ' || p_type || 's & end.' AS text FROM part")
def wiki_clean(t):
    return M.mapped(wiki(t), "raw", M.clean, "text").select("p_partkey", "text")


@query("SELECT p_partkey, 'Hello ' || upper(p_brand) || ', ' || CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END || '!' AS text FROM part")
def template_expansion(t):
    body = M.Templates({"greet": "Hello {{uc:{{{1|nobody}}}}}, {{#if:{{{big|}}}|large|{{{2|small}}}}}!<noinclude>doc</noinclude>"})
    raw = F.concat(F.lit("{{greet|"), "p_brand", F.when(F.col("p_size") > 25, F.lit("|big=1")).otherwise(""), F.lit("}}"))
    return M.mapped(t("part").select("p_partkey", raw.alias("raw")), "raw", body.expand, "text").select("p_partkey", "text")


@query("""SELECT p_partkey, CAST(p_size * 2 + 1 AS VARCHAR) || ';' || CAST(p_size % 7 AS VARCHAR) || ';' || CASE WHEN p_size > 25 AND p_size < 40 THEN '1' ELSE '0' END AS sums,
  substr(p_name, 2, 4) || ';' || length(p_type) || ';' || replace(p_type, ' ', '-') || ';' || strpos(p_type, 'S') || ';' || CASE WHEN p_size = 4 THEN 'IV' ELSE '-' END AS texts FROM part""")
def template_calls(t):
    body = M.Templates({
        "sums": "{{#expr:{{{1}}} * 2 + 1}};{{#expr:{{{1}}} mod 7}};{{#expr:{{{1}}} > 25 and {{{1}}} < 40}}",
        "Texts": "#REDIRECT [[Template:Strings]]",
        "strings": "{{#invoke:String|sub|{{{1}}}|2|5}};{{#invoke:String|len|s={{{2}}}}};{{#invoke:String|replace|{{{2}}}| |-}};{{#invoke:String|find|{{{2}}}|S}};{{#ifeq:{{{3}}}|4|{{#invoke:Roman|main|{{{3}}}}}|-}}",
    })
    p = t("part").withColumn("raw", F.concat_ws("|", F.lit("{{sums"), "p_size").cast("string")).withColumn("other", F.concat_ws("|", F.lit("{{texts"), "p_name", "p_type", "p_size"))
    p = p.select("p_partkey", F.concat("raw", F.lit("}}")).alias("raw"), F.concat("other", F.lit("}}")).alias("other"))
    p = p.repartition(2 * t.spark.sparkContext.defaultParallelism, "p_partkey")  # many rows can be in a small file
    return M.mapped(M.mapped(p, "raw", body.expand, "sums"), "other", body.expand, "texts").select("p_partkey", "sums", "texts")


@query("SELECT p_partkey, '[[' || p_partkey || '|' || p_type || ']] and ' || p_brand AS text FROM part")
def anchor_ids(t):
    p = t("part")
    raw = p.select("p_partkey", F.concat(F.lit("[[t"), "p_partkey", F.lit("|"), "p_type", F.lit("]] and [["), "p_brand", F.lit("]]")).alias("raw"))

    class Ids(dict):
        def get(self, k, default=None):
            return k[1:] if k.startswith("t") else default

    return M.mapped(raw, "raw", lambda x: M.resolved_anchors(x, Ids(), {}), "text").select("p_partkey", "text")


@query(f"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '{Z.WORD.replace("'", "''")}') AS w FROM documents)
  SELECT doc_id, len(w) AS n, length(array_to_string(w, '')) AS n_chars, w[1] AS first, w[-1] AS last FROM w""")
def word_tokens(t):
    out = Z.tokenized(t("documents").select("doc_id", "text"), "text")
    lengths = F.aggregate("tokens", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return out.select("doc_id", F.size("tokens").cast("long").alias("n"), lengths.alias("n_chars"), F.get("tokens.word", F.lit(0)).alias("first"), F.try_element_at("tokens.lemma", F.lit(-1)).alias("last"))


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN '[[e1|' || lower(p_type) || ']]' ELSE lower(p_type) END || ' of dddddd ' || lower(p_name) AS text FROM part")
def anchor_tokens(t):
    raw = F.concat(F.when(F.col("p_size") > 25, "[[Thing|").otherwise("[[Nothing|"), "p_type", F.lit("]], of 1,200 "), "p_name", F.lit(" !"))
    return M.mapped(t("part").select("p_partkey", raw.alias("raw")), "raw", lambda x: Z.token_anchors(x, entity={"Thing": "e1"}.get), "text").select("p_partkey", "text")


@query("WITH " + COUNTED + """, p AS (SELECT entity, mention, cnt / sum(cnt) OVER (PARTITION BY mention) AS pem, cnt FROM c)
  SELECT entity, mention, rank() OVER (PARTITION BY mention ORDER BY round(pem, 9) DESC) AS pem_rank, rank() OVER (PARTITION BY mention ORDER BY cnt DESC) AS cnt_rank, round(cnt / max(cnt) OVER (PARTITION BY mention), 6) AS share FROM p""")
def link_ranks(t):
    from weftline.operators.graph import priors

    p = priors(counted(t)).withColumn("pem", F.round("pem", 9))
    r = K.candidate_ranks(p, ["mention"], ["pem", "cnt"]).withColumn("share", F.col("cnt").cast("double"))
    return K.over_document_maximum(r, "mention", "share").select("entity", "mention", "pem_rank", "cnt_rank", F.round("share", 6).alias("share"))


@query("WITH " + E_ + """, j AS (SELECT a.label AS doc, a.id AS mention_id, a.id AS entity, (list_cosine_similarity(a.v, b.v) + 1) / 2 AS s FROM e a JOIN e b ON b.label = a.label AND b.id % 50 = 0)
  SELECT e.label AS doc, e.id AS entity, round(coalesce(max(s), 0), 6) AS csim_max, round(coalesce(avg(s), 0), 6) AS csim_mean FROM e LEFT JOIN j ON j.entity = e.id GROUP BY ALL""")
def entity_coherence(t):
    v = vecs(t)
    cands = v.select(F.col("label").alias("doc"), F.col("id").alias("mention_id"), F.col("id").alias("entity"), "vec")
    out = K.coherence(cands, v.where("id % 50 = 0").select(F.col("label").alias("doc"), F.col("id").alias("entity"), "vec"))
    return out.select("doc", "entity", F.round("csim_max", 6).alias("csim_max"), F.round("csim_mean", 6).alias("csim_mean"))


_COMPARED = {"esim2": ("v", "own_sense"), "esim3": ("v", "sense"), "esim5": ("v", "own_label"), "esim6": ("v", "label")} | {k: v for k, v in K.SIMILARITIES.items() if k[0] == "c"}
_NAMES = [f"esim{i}" for i in range(1, 7)] + [f"csim{i}" for i in range(1, 9)]


def _near(a: str, b: str) -> str:
    return f"(list_cosine_similarity({a}, {b}) + 1) / 2"


def _foreign(a: str, b: str) -> str:
    """SQL of a scaled cosine; 0 where a vector is missing."""
    own = a == "v" or b.startswith("own_")
    return f"CASE WHEN r.id % 2 = 0{' AND r.id % 5 > 0' if b == 'own_sense' else ''} THEN {_near(a, b)} ELSE 0 END" if own else _near(a, b)


@query("WITH " + E_ + """, r AS (SELECT id // 12 AS doc, id // 3 AS mention_id, id, v, list_reverse(v) AS trans, [abs(x) FOR x IN v] AS label, [x + 0.1 FOR x IN v] AS sense, [x * x FOR x IN v] AS centre,
  [x - 0.2 FOR x IN v] AS own_sense, [x * x - 0.1 FOR x IN v] AS own_centre, [abs(x) + 0.1 FOR x IN v] AS own_label, [x * abs(x) FOR x IN list_reverse(v)] AS context FROM e),
  c AS (SELECT r.id, max(""" + _near("r.v", "o.v") + ") AS m, avg(" + _near("r.v", "o.v") + """) AS a FROM r JOIN r o ON o.doc = r.doc AND o.id % 4 = 0 GROUP BY r.id),
  s AS (SELECT doc, mention_id, r.id AS entity, round(CASE WHEN r.id % 2 = 0 THEN """ + _near("v", "trans") + " * " + _near("trans", "sense") + " ELSE 0 END, 9) AS esim1, round(CASE WHEN r.id % 2 = 0 THEN " + _near("v", "trans") + " * " + _near("trans", "label") + """ ELSE 0 END, 9) AS esim4,
  """ + ", ".join(f"round({_foreign(a, b)}, 9) AS {n}" for n, (a, b) in _COMPARED.items()) + """, round(coalesce(m, 0), 9) AS csim2, round(coalesce(a, 0), 9) AS csim8 FROM r LEFT JOIN c ON c.id = r.id)
  SELECT doc, mention_id, entity, """ + ", ".join(f"{n}, rank() OVER (PARTITION BY doc, mention_id ORDER BY {n} DESC) AS {n.replace('sim', 'rank')}" for n in _NAMES) + " FROM s")
def link_features(t):
    v = F.transform("vec", lambda x: x.cast("double"))
    each = lambda f: F.transform("vec", f)
    rows = vecs(t).select("id", v.alias("vec")).select(
        F.expr("id div 12").alias("doc"), F.expr("id div 3").alias("mention_id"), F.col("id").alias("entity"), "vec", F.when(F.col("id") % 4 == 0, 0.99).otherwise(0.5).alias("pem"), F.col("vec").alias("own_word"), F.reverse("vec").alias("trans"),
        each(F.abs).alias("label"), each(lambda x: x + 0.1).alias("sense"), each(lambda x: x * x).alias("centre"), F.when(F.col("id") % 5 > 0, each(lambda x: x - 0.2)).alias("own_sense"),
        each(lambda x: x * x - 0.1).alias("own_centre"), each(lambda x: F.abs(x) + 0.1).alias("own_label"), F.reverse(each(lambda x: x * F.abs(x))).alias("context"),
    )
    out = K.feature_vector(rows, K.sure(rows), F.col("entity") % 2 == 0, 9)
    return out.select("doc", "mention_id", "entity", *_NAMES, *[n.replace("sim", "rank") for n in _NAMES])


@query()
def greedy_links(t):
    v = vecs(t)
    cands = v.select(F.col("label").alias("doc"), F.expr("id div 4").alias("mention_id"), F.col("id").alias("entity"), ((F.col("id") % 7 + 1) / 10).alias("pem"), F.lit(0.5).alias("csim"), F.lit(1.0).alias("trans"), "vec")
    return K.greedy(cands)


@query()
def boosted_ranks(t):
    p = t("part").select("p_partkey", F.col("p_size").cast("double").alias("a"), "p_retailprice", (F.col("p_size") > 20).cast("double").alias("y"))
    return K.boosted(p.where("p_partkey % 2 = 0"), p.where("p_partkey % 2 = 1"), ["a", "p_retailprice"], "y", trees=5).select("p_partkey", "score")


@query("SELECT p_partkey, round(1 - damerau_levenshtein(p_brand, p_type) / greatest(length(p_brand), length(p_type)), 6) AS edit FROM part")
def damerau_similarity(t):
    out = K.damerau(t("part").select("p_partkey", "p_brand", "p_type"), "p_brand", "p_type")
    return out.select("p_partkey", F.round("edit", 6).alias("edit"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey < 947 THEN 'train' WHEN o_orderkey < 1163 THEN 'testa' ELSE 'testb' END AS part FROM orders")
def document_split(t):
    return K.by_document(t("orders").select("o_orderkey"), "o_orderkey")


@query("WITH " + E_ + """, s AS (SELECT a.id // 5 AS pair, a.id AS sentence, (list_cosine_similarity(a.v, b.v) + 1) / 2 AS s FROM e a JOIN e b ON b.id = (a.id // 5) * 5)
  SELECT pair, sentence, round(s / sum(s) OVER (PARTITION BY pair), 6) AS attention FROM s""")
def kg_attention(t):
    v = vecs(t).withColumn("pair", F.expr("id div 5"))
    heads = v.where("id % 5 = 0").select("pair", F.col("vec").alias("entity_vec"))
    out = T.graph_attention(v.join(heads, "pair").select("pair", F.col("id").alias("sentence"), "vec", "entity_vec"))
    return out.select("pair", "sentence", F.round("attention", 6).alias("attention"))


@query("SELECT l_orderkey AS pair, l_linenumber AS k, round(l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey), 6) AS weight FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey) > 1")
def combined_attention(t):
    out = T.combined_attention(t("lineitem").select(F.col("l_orderkey").alias("pair"), F.col("l_linenumber").alias("k"), "l_quantity"), "l_quantity", None)
    return out.select("pair", "k", F.round("weight", 6).alias("weight"))


@query("WITH " + E_ + """, m AS (SELECT id // 4 AS pair, id % 2 + 1 AS side, id AS word, v FROM e), x AS (SELECT pair, side, word, unnest(v) AS x, unnest(range(64)) AS i FROM m),
  d AS (SELECT pair, i, sum(CASE WHEN side = 1 THEN 0.5 ELSE -0.5 END * x) AS d FROM x GROUP BY ALL), g AS (SELECT word, x.i, (CASE WHEN side = 1 THEN -0.5 ELSE 0.5 END) * d AS g FROM x JOIN d USING (pair, i))
  SELECT word, list(round(g, 6) ORDER BY i) AS gradient FROM g GROUP BY word""")
def parallel_regression(t):
    v = vecs(t).select(F.expr("id div 4").alias("pair"), (F.col("id") % 2 + 1).alias("side"), F.col("id").alias("word"), F.lit(0.5).alias("weight"), "vec")
    return T.regression_step(v).select("word", F.transform("gradient", lambda x: V.rounded(x, 6)).alias("gradient"))


@query()
def hungarian(t):
    v = vecs(t).withColumn("pair", F.expr("id div 8"))
    part = lambda c: F.collect_list(F.when(c, F.col("vec")))
    return T.word_attention(v.groupBy("pair").agg(part(F.col("id") % 8 < 3).alias("left"), part(F.col("id") % 8 >= 3).alias("right")).where("size(left) > 0 and size(right) > 0"))
