"""Queries on the line formats: lines are made of table columns and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.sources import files, lines as L

from .base import query

NL, TAB = "\n", "\t"


def annotated(t):
    """n, value: "word [[p_name|p_brand]] word {{p_type}}"."""
    value = F.concat(F.lit("see [["), "p_name", F.lit("|"), "p_brand", F.lit("]] or [["), "p_brand", F.lit("]] with {{"), "p_type", F.lit("}}"))
    return t("part").select(F.lit("f").alias("file"), F.col("p_partkey").alias("n"), value.alias("value"))


@query("SELECT p_partkey AS n, unnest([p_name, p_brand]) AS entity, unnest([p_brand, p_brand]) AS mention FROM part")
def anchor_lexer(t):
    return annotated(t).select("n", F.explode(L.anchors(F.col("value"))).alias("a")).select("n", "a.entity", "a.mention")


@query("SELECT p_partkey AS n, p_type AS mention FROM part")
def mention_lexer(t):
    return annotated(t).select("n", F.explode(L.mentions(F.col("value"))).alias("mention"))


@query("""WITH p AS (SELECT p_partkey AS n, p_name, p_brand, p_type, unnest(range(6)) AS i FROM part)
  SELECT n, i, ['word', 'anchor', 'word', 'anchor', 'word', 'mention'][i + 1] AS kind, [NULL, p_name, NULL, p_brand, NULL, NULL][i + 1] AS entity, ['see', p_brand, 'or', p_brand, 'with', p_type][i + 1] AS surface FROM p""")
def annotated_tokens(t):
    out = annotated(t).select("n", F.posexplode(L.tokens(F.col("value"))).alias("i", "k"))
    return out.select("n", F.col("i").cast("long").alias("i"), "k.kind", "k.entity", "k.surface")


@query("SELECT c_custkey AS k, unnest([c_name, c_mktsegment, CAST(c_nationkey AS VARCHAR)]) AS item FROM customer")
def item_reader(t):
    line = F.concat_ws("\t", "c_name", "c_mktsegment", F.concat(F.lit(" "), F.col("c_nationkey"), F.lit(" ")))
    return t("customer").select(F.col("c_custkey").alias("k"), F.explode(L.items(line)).alias("item"))


@query("SELECT c_custkey AS k, unnest([c_name || ' x', c_mktsegment]) AS item FROM customer")
def entity_reader(t):
    line = F.concat(F.col("c_name"), F.lit(" x;"), F.col("c_mktsegment"))
    return t("customer").select(F.col("c_custkey").alias("k"), F.explode(L.entities(line)).alias("item"))


@query("SELECT p_partkey AS k, len(string_split(p_name, ' ')) AS n FROM part")
def mention_splitter(t):
    return t("part").select(F.col("p_partkey").alias("k"), F.size(L.mention_words(F.col("p_name"))).cast("long").alias("n"))


@query("SELECT c_mktsegment AS item, CAST(c_custkey AS VARCHAR) AS cn FROM customer WHERE c_custkey % 3 <> 0")
def tsv_reader(t):
    broken = F.when(F.col("c_custkey") % 3 == 0, F.lit("only one")).otherwise(F.concat_ws("\t", "c_mktsegment", "c_custkey"))
    return L.rows_of(t("customer").select(broken.alias("value")), ["item", "cn"])


def inserts(t, columns):
    """INSERT lines with several tuples each."""
    one = F.concat_ws(",", *columns)
    rows = t("nation").groupBy("n_regionkey").agg(F.concat(F.lit("INSERT INTO `x` VALUES ("), F.concat_ws("),(", F.collect_list(one)), F.lit(");")).alias("value"))
    return rows


def quoted(c):
    return F.concat(F.lit("'"), c, F.lit("'"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS title FROM nation WHERE n_nationkey % 5 <> 0")
def redirect_dump(t):
    ns = F.when(F.col("n_nationkey") % 5 == 0, "1").otherwise("0")
    return L.redirect_rows(inserts(t, ["n_nationkey", ns, quoted(F.col("n_name")), F.lit("''"), F.lit("''")]))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS title FROM nation WHERE n_nationkey % 5 <> 0")
def pagelink_dump(t):
    ns = F.when(F.col("n_nationkey") % 5 == 0, "1").otherwise("0")
    return L.pagelink_rows(inserts(t, ["n_nationkey", ns, quoted(F.col("n_name")), F.lit("0")]))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, CASE n_nationkey % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'zh' ELSE 'es' END AS lang, n_name AS title FROM nation WHERE n_nationkey % 4 < 3")
def langlink_dump(t):
    lang = F.element_at(F.array(F.lit("en"), F.lit("zh"), F.lit("es"), F.lit("de")), F.col("n_nationkey") % 4 + 1)
    return L.langlink_rows(inserts(t, ["n_nationkey", quoted(lang), quoted(F.col("n_name"))]))


@query("SELECT c_mktsegment AS title, CAST(max(c_custkey) AS VARCHAR) AS id FROM customer GROUP BY 1")
def page_index(t):
    line = F.concat_ws(":", F.col("c_custkey") * 7, "c_custkey", "c_mktsegment")
    return L.index_rows(t("customer").select(F.col("c_custkey").alias("n"), line.alias("value")))


@query("""WITH l AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS r2, lead(text) OVER w AS t2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  SELECT conv_id AS file, turn AS n, text AS first, t2 AS second FROM l WHERE role = 'user' AND r2 = 'assistant'""")
def parallel_line_pairs(t):
    tag = F.when(F.col("role") == "user", "1").otherwise("2")
    clean = F.translate("text", "\t", " ")
    out = L.paired_lines(t("conversations").where("role in ('user', 'assistant')").select(F.col("conv_id").alias("file"), F.col("turn").alias("n"), F.concat_ws("\t", tag, "text").alias("value")), "file")
    return out.select("file", "n", F.expr("substr(first, 3)").alias("first"), F.expr("substr(second, 3)").alias("second"))


@query("SELECT doc_id, source AS article, lang AS entity, len(list_filter(string_split(text, chr(10))[:20], lambda s: trim(s) <> '')) AS n FROM documents WHERE text NOT LIKE '%' || chr(9) || '%' AND len(list_filter(string_split(text, chr(10))[:20], lambda s: trim(s) <> '')) > 0")
def parallel_reader(t):
    docs = t("documents").where("text not like '%\t%'")
    line = F.concat_ws("\t", F.lit("1"), "source", "lang", F.replace("text", F.lit("\n"), F.lit("\t")))
    side = docs.select("doc_id", L.parallel_side(line).alias("s")).where("s is not null")
    return side.select("doc_id", "s.article", "s.entity", F.size("s.sentences").cast("long").alias("n"))


@query("""WITH l AS (SELECT p_partkey AS n, CASE WHEN p_partkey % 10 = 1 THEN NULL ELSE 1 END AS q, p_type FROM part), s AS (SELECT *, count(*) FILTER (q IS NULL) OVER (ORDER BY n) AS section FROM l)
  SELECT n, section, upper(p_type) AS last FROM s WHERE q IS NOT NULL""")
def analogy_sections(t):
    line = F.when(F.col("p_partkey") % 10 == 1, F.concat(F.lit(": "), "p_brand")).otherwise(F.concat(F.lit("a b c "), F.replace("p_type", F.lit(" "), F.lit("_"))))
    out = L.sections(t("part").select(F.lit("f").alias("file"), F.col("p_partkey").alias("n"), line.alias("value")))
    return out.select("n", "section", F.replace(F.col("w")[3], F.lit("_"), F.lit(" ")).alias("last"))


@query("""SELECT 'd' || o_custkey AS doc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k, o_orderkey AS start, o_orderpriority AS mention, 'w' || (o_orderkey % 50) AS id
  FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 50 < 40""")
def gold_mentions(t):
    kb = F.when(F.col("o_orderkey") % 7 == 0, F.lit("NIL1")).otherwise(F.concat(F.lit("k"), F.col("o_orderkey") % 50))
    span = F.concat(F.lit("d"), "o_custkey", F.lit(":"), "o_orderkey", F.lit("-"), F.col("o_orderkey") + 5)
    rows = t("orders").select(F.concat_ws("\t", F.lit("x"), F.lit("q"), "o_orderpriority", span, kb).alias("value"))
    ids = t.spark.range(40).select(F.concat(F.lit("k"), "id").alias("kb"), F.concat(F.lit("w"), "id").alias("id"))
    out = L.gold_mentions(rows, ids).select("doc", F.posexplode("mentions").alias("k", "m"))
    return out.select("doc", F.col("k").cast("long").alias("k"), "m.start", "m.mention", "m.id")


@query("SELECT 1 AS doc, CAST(o_custkey AS VARCHAR) AS mention, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS length, o_orderpriority AS entity FROM orders")
def conll_reader(t):
    o = t("orders")
    first = o.select((F.col("o_orderkey") * 2).alias("n"), F.concat_ws("\t", F.lit("w"), F.lit("B"), "o_custkey", F.lit("y"), "o_orderpriority").alias("value"))
    more = o.where("o_orderkey % 2 = 0").select((F.col("o_orderkey") * 2 + 1).alias("n"), F.concat_ws("\t", F.lit("w"), F.lit("I"), "o_custkey", F.lit("y"), "o_orderpriority").alias("value"))
    head = t.spark.createDataFrame([(-1, "-DOCSTART-")], "n long, value string")
    return L.conll(head.union(first).union(more).withColumn("file", F.lit("f")))


@query("""WITH l AS (SELECT conv_id, turn, text, coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - 1 AS o FROM conversations)
  SELECT conv_id AS file, turn AS n, CAST(o AS BIGINT) AS "offset" FROM l WHERE NOT regexp_full_match(text, '<.*>')""")
def forum_offsets(t):
    rows = t("conversations").select(F.col("conv_id").alias("file"), F.col("turn").alias("n"), F.col("text").alias("value"))
    return L.forum_offsets(rows).select("file", "n", F.col("offset").cast("long").alias("offset"))


@query("SELECT page_id AS file, 2 AS n, url AS value FROM pages UNION ALL SELECT page_id, 5, url FROM pages")
def newswire_regions(t):
    body = F.array(F.lit("skip"), F.lit("<TEXT>"), F.col("url"), F.lit("</TEXT>"), F.lit("<HEADLINE>"), F.col("url"), F.lit("</HEADLINE>"), F.lit("skip"))
    rows = t("pages").select(F.col("page_id").alias("file"), F.posexplode(body).alias("n", "value"))
    return L.in_region(rows)


@query(r"SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(text, '[.!?！？｡。]'), lambda s: trim(s)), lambda s: s <> '')) AS s FROM documents")
def sentence_split(t):
    return t("documents").select("doc_id", F.explode(L.sentences(F.col("text"))).alias("s"))


@query("SELECT CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS en, CASE WHEN n_nationkey % 3 = 0 THEN 'z' || n_name END AS zh, 's' || n_name AS es FROM nation")
def cross_link_reader(t):
    part = lambda k, p: F.when(F.col("n_nationkey") % k == 0, F.concat(F.lit(p), "n_name")).otherwise("")
    rows = t("nation").select((F.col("n_nationkey") + 2).alias("n"), F.concat_ws("\t", part(2, ""), part(3, "z"), F.concat(F.lit("s"), "n_name")).alias("value"))
    heads = t.spark.createDataFrame([(0, "25"), (1, "en\tzh\tes")], "n int, value string")
    return L.cross_links(rows.union(heads))


@query("SELECT p_brand AS word, unnest(string_split(p_name, ' ')) AS translation FROM part")
def lexicon_reader(t):
    return L.lexicon(t("part").select(F.concat_ws("\t", "p_brand", "p_name").alias("value")))


@query("SELECT CAST(l_suppkey AS VARCHAR) AS entity, l_shipmode AS mention, cnt FROM (SELECT l_suppkey, l_returnflag || l_linestatus AS l_shipmode, count(*) AS cnt FROM lineitem GROUP BY ALL)")
def mention_count_reader(t):
    counts = t("lineitem").groupBy("l_suppkey", F.concat("l_returnflag", "l_linestatus").alias("m")).agg(F.count("*").alias("c"))
    rows = counts.groupBy("l_suppkey").agg(F.concat_ws("\t", F.collect_list(F.concat("m", F.lit("::="), "c"))).alias("f"))
    return L.mention_counts(rows.select(F.concat_ws("\t", "l_suppkey", F.lit("0.5"), "f").alias("value")))


@query("SELECT o_custkey || chr(9) || string_agg(DISTINCT CAST(o_orderkey AS VARCHAR), chr(9) ORDER BY CAST(o_orderkey AS VARCHAR)) AS value FROM orders GROUP BY o_custkey")
def adjacency_writer(t):
    return files.adjacency_lines(t("orders"), "o_custkey", "o_orderkey")


@query("SELECT c_custkey || chr(9) || c_name AS value FROM customer")
def tsv_writer(t):
    return files.tsv_lines(t("customer"), "c_custkey", "c_name")


@query("""SELECT '{"id":' || page_id || ',"url":"' || url || '","title":"t","text":"x"}' AS value FROM pages""")
def page_json_writer(t):
    return files.page_json(t("pages").select(F.col("page_id").alias("id"), "url", F.lit("t").alias("title"), F.lit("x").alias("text")))


@query("""SELECT '<doc id="' || page_id || '" url="' || url || '" title="t">' || chr(10) || 'x' || chr(10) || '</doc>' AS value FROM pages""")
def page_block_writer(t):
    return files.page_blocks(t("pages").select(F.col("page_id").alias("id"), "url", F.lit("t").alias("title"), F.lit("x").alias("text")))


@query("SELECT unnest(['1' || chr(9) || c_custkey || chr(9) || c_name || chr(9) || 'a b', '2' || chr(9) || c_custkey || chr(9) || c_mktsegment || chr(9) || 'c']) AS value FROM customer")
def parallel_writer(t):
    c = t("customer")
    return files.parallel_lines(c.select(
        F.col("c_custkey").cast("string").alias("article1"), F.col("c_name").alias("entity1"), F.array(F.lit("a b")).alias("sentences1"),
        F.col("c_custkey").cast("string").alias("article2"), F.col("c_mktsegment").alias("entity2"), F.array(F.lit("c")).alias("sentences2"),
    ))
