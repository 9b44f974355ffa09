"""Queries on text normalisation and vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import text, vectors
from weftline.operators import vocabulary as V

from .base import Tables, query

#: regularize() in DuckDB, which has no look-around.
CLEAN = r"""trim(lower(CASE WHEN {c} = ' ' THEN 'dddddd' ELSE regexp_replace(regexp_replace({c} || ' ', ' [0-9][0-9 ]* ', ' dddddd ', 'g'), '^[0-9][0-9 ]* ', 'dddddd ') END))"""
SQUEEZED = r"""regexp_replace(regexp_replace({c}, '[!-/:-@\[-`{{-~]', '', 'g'), '\s+', ' ', 'g')"""


def clean_sql(column: str) -> str:
    return CLEAN.format(c=SQUEEZED.format(c=column))


CLEANED = f"WITH clean AS (SELECT *, {clean_sql('text')} AS t FROM documents WHERE text IS NOT NULL) "
WORDS = CLEANED + ", w AS (SELECT doc_id, lang, unnest(string_split(t, ' ')) AS item FROM clean), words AS (SELECT * FROM w WHERE item <> ''), "
COUNTS = WORDS + "counts AS (SELECT item, count(*) AS cn FROM (SELECT item FROM words UNION ALL SELECT '</s>' FROM clean) GROUP BY item), "
VOCAB = COUNTS + """vocab AS (SELECT row_number() OVER (ORDER BY item <> '</s>', cn DESC, item) - 1 AS id, item, cn FROM counts WHERE cn >= 5 OR item = '</s>') """


def cleaned(t: Tables) -> DataFrame:
    return t("documents").where("text is not null").withColumn("t", text.regularize(F.col("text")))


def counts(t: Tables) -> DataFrame:
    return V.word_counts(cleaned(t), text.words(F.col("t")))


@query(CLEANED + "SELECT doc_id, t AS clean FROM clean")
def regularize_docs(t):
    return cleaned(t).select("doc_id", F.col("t").alias("clean"))


@query(r"""SELECT doc_id, trim(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  regexp_replace(text, '[!-/:-@\[-`{-~]', ' ', 'g'), '\s+', ' ', 'g') || ' ', ' [0-9]+ ', ' dddddd ', 'g'), ' [0-9]+ ', ' dddddd ', 'g'), '^[0-9]+ ', 'dddddd '))) AS mapped
  FROM documents WHERE text IS NOT NULL""")
def maprule_docs(t):
    return t("documents").where("text is not null").select("doc_id", text.maprule(F.col("text")).alias("mapped"))


@query(CLEANED + ", l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM clean), k AS (SELECT doc_id, " + clean_sql("line") + " AS x FROM l) SELECT doc_id, x FROM k WHERE length(x) > 11")
def clean_lines(t):
    lines = t("documents").where("text is not null").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    out = lines.select("doc_id", text.regularize(F.col("line")).alias("x"))
    return out.where(text.long_enough(F.col("x")))


@query("SELECT doc_id, source AS variant FROM documents")
def zh_variants(t):
    marked = F.concat(F.lit("-{zh-hans:"), F.col("source"), F.lit(";zh-tw:x}-"))
    return t("documents").select("doc_id", text.simplified(marked).alias("variant"))


@query("SELECT p_partkey, trim(p_name) AS title, len(string_split(trim(p_name), ' ')) AS n FROM part")
def strip_suffix(t):
    label = F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))
    return t("part").select("p_partkey", text.without_suffix(label).alias("title"), text.mention_length(label).cast("long").alias("n"))


@query("SELECT p_partkey, 'see ' || p_name || ' and ' || p_brand || ' or ' || p_type AS plain FROM part")
def plain_labels(t):
    line = F.concat(F.lit("see [["), "p_partkey", F.lit("|"), "p_name", F.lit("]] and [["), "p_brand", F.lit("]] or {{"), "p_type", F.lit("}}"))
    return t("part").select("p_partkey", text.plain_text(line).alias("plain"))


@query("SELECT p_partkey, upper(p_name[1]) || p_name[2:] AS title, upper(p_name[1]) || p_name[2:] AS up, lower(p_brand[1]) || p_brand[2:] AS low FROM part")
def normalize_titles(t):
    raw = F.concat(F.lit("__"), F.regexp_replace("p_name", " ", "__ "), F.lit("_ "))
    return t("part").select("p_partkey", text.normal_title(raw).alias("title"), text.upper_first(F.col("p_name")).alias("up"), text.lower_first(F.col("p_brand")).alias("low"))


@query("SELECT page_id, replace(replace(replace(replace(replace(html, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&') AS t FROM (SELECT page_id, replace(html, '&#39;', chr(39)) AS html FROM pages)")
def unescape_pages(t):
    return t("pages").select("page_id", text.unescape(F.col("html")).alias("t"))


@query("SELECT c_custkey, length(c_name) AS n, substr(c_name, 3, 4) AS part, strpos(c_name, '#') AS at, replace(c_name, '#', '-') AS other, repeat(c_mktsegment, 2) AS twice, coalesce(nullif(c_mktsegment, ''), 'none') AS filled FROM customer")
def string_module(t):
    return t("customer").select(
        "c_custkey", F.length("c_name").cast("long").alias("n"), F.substring("c_name", 3, 4).alias("part"), F.instr("c_name", "#").cast("long").alias("at"),
        F.replace("c_name", F.lit("#"), F.lit("-")).alias("other"), F.repeat("c_mktsegment", 2).alias("twice"), F.coalesce(F.nullif("c_mktsegment", F.lit("")), F.lit("none")).alias("filled"),
    )


@query("""SELECT a.p_partkey AS a, b.p_partkey AS b, CAST(lower(a.p_brand) = lower(b.p_type) AS INT) AS same, CAST(strpos(lower(b.p_name), lower(a.p_brand)) <> 1 AS INT) AS not_prefix,
  CAST(starts_with(lower(b.p_name), lower(a.p_brand)) AS INT) AS prefix, CAST(suffix(lower(b.p_name), lower(a.p_brand)) AS INT) AS suffix, CAST(contains(lower(b.p_name), lower(a.p_brand)) AS INT) AS contains,
  round(1 - levenshtein(a.p_brand, b.p_type) / greatest(length(a.p_brand), length(b.p_type)), 6) AS edit
  FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1""")
def string_similarity(t):
    a, b = t("part").alias("a"), t("part").alias("b")
    j = a.join(b, F.col("b.p_partkey") == F.col("a.p_partkey") + 1)
    _, *others = text.string_features(F.col("a.p_brand"), F.col("b.p_name"))
    same = (F.lower("a.p_brand") == F.lower("b.p_type")).cast("int").alias("same")
    return j.select(F.col("a.p_partkey").alias("a"), F.col("b.p_partkey").alias("b"), same, *others, F.round(text.edit_similarity(F.col("a.p_brand"), F.col("b.p_type")), 6).alias("edit"))


@query(VOCAB + """, s AS (SELECT CAST(sum(cn) AS DOUBLE) AS total, sum(pow(cn, 0.75)) AS mass FROM vocab)
  SELECT id, item, cn, round((sqrt(cn / (1e-4 * total)) + 1) * (1e-4 * total) / cn, 6) AS keep, round(pow(cn, 0.75) / mass, 9) AS noise FROM vocab, s""")
def word_vocab(t):
    out = V.with_rates(V.ranked(counts(t)))
    return out.select("id", "item", "cn", F.round("keep", 6).alias("keep"), F.round("noise", 9).alias("noise"))


@query(COUNTS + "x AS (SELECT 1) SELECT item, cn FROM counts")
def word_counts(t):
    return counts(t)


@query(COUNTS + "x AS (SELECT 1) SELECT item, cn FROM counts ORDER BY cn DESC, item LIMIT 100")
def frequent_words(t):
    return V.frequent(counts(t), 100)


@query(COUNTS + """s AS (SELECT cn, sum(count(*)) OVER (ORDER BY cn DESC) AS upto FROM counts GROUP BY cn) SELECT item, cn FROM counts WHERE cn IN (SELECT cn FROM s WHERE upto <= 500)""")
def bounded_vocab(t):
    return V.lossy(counts(t), 500).select("item", "cn")


@query("""WITH e AS (SELECT DISTINCT l_orderkey AS head, l_partkey AS dst FROM lineitem), i AS (SELECT DISTINCT 'o' || head AS item, head FROM e UNION ALL SELECT 'p' || dst, head FROM e)
  SELECT item, count(*) AS cn FROM i GROUP BY item""")
def entity_counts(t):
    rows = t("lineitem").groupBy("l_orderkey").agg(F.collect_set(F.concat(F.lit("p"), F.col("l_partkey"))).alias("outs"))
    return V.graph_counts(rows.select(F.concat(F.lit("o"), F.col("l_orderkey")).alias("head"), "outs"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS item, count(l_partkey) AS cn FROM part LEFT JOIN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') ON l_partkey = p_partkey GROUP BY ALL""")
def sense_vocab(t):
    anchors = t("lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").cast("string").alias("item"))
    return V.sense_counts(t("part").select(F.col("p_partkey").cast("string").alias("item")), anchors)


@query(WORDS + "x AS (SELECT 1) SELECT lang, count(*) AS n_words, count(DISTINCT item) AS n_distinct FROM words GROUP BY lang")
def vocab_stats(t):
    w = cleaned(t).select("lang", F.explode(text.words(F.col("t"))).alias("item"))
    pairs = w.groupBy("lang", "item").agg(F.count("*").alias("n"))  # not count(distinct): one row a word and language is all that is shuffled
    return pairs.groupBy("lang").agg(F.sum("n").alias("n_words"), F.count("*").alias("n_distinct"))


@query("WITH b AS (SELECT DISTINCT unnest(string_split(" + clean_sql("text") + ", ' ')) AS item FROM benchmark), " + (COUNTS + "x AS (SELECT 1)")[5:] + " SELECT item, cn FROM counts SEMI JOIN b USING (item)")
def restricted_vocab(t):
    asked = t("benchmark").select(F.explode(text.words(text.regularize(F.col("text")))).alias("item")).distinct()
    return counts(t).join(asked, "item", "left_semi")


@query("""WITH w AS (SELECT p_type AS word, count(*) AS cn FROM part GROUP BY p_type), s AS (SELECT word, cn, string_split(word, '') AS c FROM w),
  p AS (SELECT unnest(list_zip(c[:-2], c[2:])) AS z, cn FROM s WHERE len(c) > 1)
  SELECT z[1] AS a, z[2] AS b, CAST(sum(cn) AS BIGINT) AS cn FROM p GROUP BY ALL""")
def bpe_pair_counts(t):
    words = t("part").groupBy("p_type").agg(F.count("*").alias("cn")).select(F.split("p_type", "").alias("symbols"), "cn")
    return V.pair_counts(words)


@query()
def bpe_merges(t):
    words = t("part").groupBy("p_type").agg(F.count("*").alias("cn")).select(F.concat(F.split("p_type", ""), F.array(F.lit("</w>"))).alias("symbols"), "cn")
    found = [(i, *m) for i, m in enumerate(V.learn_merges(words))]
    return t.spark.createDataFrame(found, "k int, a string, b string, cn long")


@query("""SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) / sum(value) OVER (PARTITION BY user_id), 6) AS cdf FROM events WHERE value > 0""")
def sampling_cdf(t):
    out = V.cumulative(t("events").where("value > 0").select("event_id", "user_id", "value"), "user_id", "event_id", "value")
    return out.select("event_id", F.round("cdf", 6).alias("cdf"))


@query("SELECT doc_id, round(1 / (1 + exp(-x)), 6) AS sig, round(CASE WHEN x > 6 THEN 0 WHEN x < -6 THEN 1 ELSE 1 - 1 / (1 + exp(-x)) END, 6) AS g, round(greatest(-0.1, least(0.1, x)), 6) AS clip, abs(x - 1) < 1e-6 AS near, round(pow(p, 0.1), 6) AS smooth FROM (SELECT doc_id, (n_chars % 200 - 100) / 10.0::DOUBLE AS x, (n_chars % 10 + 1) / 10.0::DOUBLE AS p FROM documents)")
def scalar_math(t):
    x, p = (F.col("n_chars") % 200 - 100) / 10.0, (F.col("n_chars") % 10 + 1) / 10.0
    return t("documents").select(
        "doc_id", F.round(vectors.sigmoid(x), 6).alias("sig"), vectors.rounded(vectors.gradient_scale(x, F.lit(1)), 6).alias("g"), vectors.rounded(vectors.clipped(x), 6).alias("clip"),
        vectors.near(x, F.lit(1.0)).alias("near"), F.round(vectors.smoothed(p), 6).alias("smooth"),
    )
