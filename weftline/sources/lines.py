"""Readers of the line formats, as columns over lines. Malformed lines are dropped, never an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions.running import running

LANGUAGES = ("en", "zh", "es")
SENTENCE_END = "[.!?！？｡。]"
#: A mention or anchor holds fewer blanks than this.
MOST_BLANKS = 135
#: Line numbers in a slice of a file; sums over a file's lines go by slices, so that a long file isn't one task.
SLICE = 1 << 17


def _summed(df: DataFrame, by: str, sums: dict[str, Column], before: bool = False) -> DataFrame:
    return running(df, [by], "n", F.floor(F.col("n") / SLICE), sums, before)


def lines(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """file, n, value: the lines of files that a task can hold, numbered from 0 within their file."""
    raw = spark.read.option("encoding", encoding).text(path, wholetext=True)
    whole = raw.select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("n", "value"))
    return whole.where("value <> '' or n = 0")


def ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, n, value for files of any size, read in splits: n orders a file's lines, but isn't their number."""
    raw = spark.read.text(path)
    place = F.col("_metadata.file_block_start").cast("decimal(38,0)") * F.lit(1 << 34) + F.monotonically_increasing_id() % F.lit(1 << 33)
    return raw.select(F.col("_metadata.file_path").alias("file"), place.cast("decimal(38,0)").alias("n"), "value")


def fields(c: Column, separator: str = "\t") -> Column:
    return F.split(c, separator)


def rows_of(df: DataFrame, names: list[str], separator: str = "\t", exactly: bool = True) -> DataFrame:
    """value split into named columns; lines with another number of fields (or fewer, if not exactly) are dropped."""
    parts = df.withColumn("_p", F.split("value", separator))
    size = F.size("_p") == len(names) if exactly else F.size("_p") >= len(names)
    others = [c for c in df.columns if c != "value"]
    return parts.where(size).select(*others, *[F.col("_p")[i].alias(x) for i, x in enumerate(names) if x != "_"])


def items(c: Column) -> Column:
    """Fields split by blanks, tabs or line ends."""
    return F.filter(F.split(c, "[ \t]+"), lambda x: x != "")


def entities(c: Column) -> Column:
    """Fields split by ; or tabs; blanks stay."""
    return F.filter(F.split(c, "[;\t]"), lambda x: x != "")


def mention_words(mention: Column) -> Column:
    """The words of a mention; null where there are too many."""
    w = F.filter(F.split(mention, " "), lambda x: x != "")
    return F.when(F.size(w) < MOST_BLANKS, w)


def anchors(c: Column) -> Column:
    """array<struct<entity, mention>> of [[entity|mention]] and [[entity]]; the last | divides."""
    found = F.regexp_extract_all(c, F.lit("\\[\\[([^\\]\\n]*)\\]\\]"), 1)
    found = F.filter(found, lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "))) < MOST_BLANKS)
    entity = lambda x: F.when(F.contains(x, F.lit("|")), F.regexp_extract(x, "^(.*)\\|[^|]*$", 1)).otherwise(x)
    mention = lambda x: F.regexp_extract(x, "([^|]*)$", 1)
    return F.transform(found, lambda x: F.struct(entity(x).alias("entity"), mention(x).alias("mention")))


def mentions(c: Column) -> Column:
    """The texts of {{...}}."""
    return F.filter(F.regexp_extract_all(c, F.lit("\\{\\{([^}\\n]*)\\}\\}"), 1), lambda x: F.size(F.split(x, " ")) <= MOST_BLANKS)


def tokens(c: Column) -> Column:
    """A line of annotated text as array<struct<kind, entity, surface>>: word, anchor or mention."""
    c = F.regexp_replace(c, "\r", "")
    raw = F.regexp_extract_all(c, F.lit("(\\[\\[[^\\]\\n]*\\]\\]|\\{\\{[^}\\n]*\\}\\}|[^\\s\\[\\]{}]+)"), 1)

    def one(x: Column) -> Column:
        anchor, mention = F.startswith(x, F.lit("[[")), F.startswith(x, F.lit("{{"))
        inner = F.regexp_extract(x, "^(?:\\[\\[|\\{\\{)(.*)(?:\\]\\]|\\}\\})$", 1)
        kind = F.when(anchor, "anchor").when(mention, "mention").otherwise("word")
        entity = F.when(anchor, F.when(F.contains(inner, F.lit("|")), F.regexp_extract(inner, "^(.*)\\|[^|]*$", 1)).otherwise(inner))
        surface = F.when(anchor | mention, F.regexp_extract(inner, "([^|]*)$", 1)).otherwise(x)
        return F.struct(kind.alias("kind"), entity.alias("entity"), surface.alias("surface"))

    return F.transform(raw, one)


def sql_tuples(c: Column) -> Column:
    """The tuples of an INSERT statement's line."""
    return F.explode(F.split(c, "\\),\\("))


def redirect_rows(df: DataFrame) -> DataFrame:
    """value of redirect dumps -> id, title (namespace 0)."""
    t = df.select(sql_tuples(F.col("value")).alias("t"))
    pattern = "(\\d+),0,'((?:[^'\\\\]|\\\\.)*)','[^']*','[^']*'"
    return t.select(F.regexp_extract("t", pattern, 1).alias("id"), F.regexp_extract("t", pattern, 2).alias("title")).where("id <> ''")


def pagelink_rows(df: DataFrame) -> DataFrame:
    """value of page link dumps -> id, title (between pages of namespace 0)."""
    t = df.select(sql_tuples(F.col("value")).alias("t"))
    pattern = "(\\d+),0,'((?:[^'\\\\]|\\\\.)*)',0"
    return t.select(F.regexp_extract("t", pattern, 1).alias("id"), F.regexp_extract("t", pattern, 2).alias("title")).where("id <> ''")


def langlink_rows(df: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    t = df.select(sql_tuples(F.col("value")).alias("t"))
    pattern = "(\\d+),'([a-z-]+)','((?:[^'\\\\]|\\\\.)*)'"
    out = t.select(*[F.regexp_extract("t", pattern, i).alias(n) for i, n in enumerate(("id", "lang", "title"), 1)])
    return out.where(F.col("lang").isin(*languages) & (F.col("title") != ""))


def index_rows(df: DataFrame) -> DataFrame:
    """n, value ("offset:id:title") -> title, id; the last line of a title wins."""
    p = "^(\\d+):(\\d+):(.+)$"
    out = df.select("n", F.regexp_extract("value", p, 2).alias("id"), F.regexp_extract("value", p, 3).alias("title")).where("id <> ''")
    return out.groupBy("title").agg(F.max_by("id", "n").alias("id"))


def paired_lines(df: DataFrame, by: str = "file") -> DataFrame:
    """file, n, value -> first, second: a line tagged 1 and the line tagged 2 right after it."""
    tag = F.split("value", "\t")[0]
    nxt = F.lead("value").over(Window.partitionBy(by).orderBy("n"))
    both = df.select(by, "n", "value", tag.alias("tag"), nxt.alias("second")).where((F.col("tag") == "1") & (F.split("second", "\t")[0] == "2"))
    return both.select(by, "n", F.col("value").alias("first"), "second")


def parallel_side(c: Column, most: int = 20) -> Column:
    """struct<article, entity, sentences>; null where there are fewer than three fields or no sentence."""
    f = F.split(c, "\t")
    sentences = F.filter(F.slice(f, 4, most), lambda s: F.trim(s) != "")
    return F.when((F.size(f) >= 4) & (F.size(sentences) > 0), F.struct(f[1].alias("article"), f[2].alias("entity"), sentences.alias("sentences")))


def sections(df: DataFrame, by: str = "file") -> DataFrame:
    """Lines ": name" head sections; other lines (four words, upper case) get their section's number."""
    head = F.startswith("value", F.lit(":"))
    numbered = _summed(df, by, {"section": head.cast("int")})
    w = F.split(F.upper("value"), " +")
    return numbered.where(~head).select(by, "n", "section", w.alias("w")).where("size(w) = 4")


def gold_mentions(df: DataFrame, ids: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """n, value (tab fields: _, mention, doc:start-end, kb id) -> doc, mentions sorted by start; rows
    of fewer than five fields or without an id in ids (kb, id) are dropped."""
    f = F.split("value", "\t")
    m = df.select(f.alias("f")).where("size(f) >= 5 and not startswith(f[4], 'NIL')")
    m = m.select(F.col("f")[2].alias("mention"), F.split(F.col("f")[3], "[:-]").alias("p"), F.col("f")[4].alias("kb"))
    m = m.select("mention", "kb", F.col("p")[0].alias("doc"), F.col("p")[1].cast("long").alias("start"), F.col("p")[2].cast("long").alias("stop")).join(ids, "kb")
    if redirects is not None:
        m = m.join(redirects.select(F.col("from").alias("id"), "to"), "id", "left").withColumn("id", F.coalesce("to", "id")).drop("to")
    return m.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "mention", "id"))).alias("mentions"))


def conll(df: DataFrame, by: str = "file") -> DataFrame:
    """file, n, value (token, B or I, mention, ..., entity) -> doc, mention, length, entity for each mention."""
    f = F.split("value", "\t")
    rows = df.withColumn("tag", F.get(f, F.lit(1)))
    rows = _summed(rows, by, {"doc": F.startswith("value", F.lit("-DOCSTART-")).cast("int"), "k": (F.col("tag") == "B").cast("int")}).where(F.col("tag").isin("B", "I"))
    return rows.groupBy("doc", "k").agg(F.min_by(F.get(f, F.lit(2)), "n").alias("mention"), F.count("*").alias("length"), F.min_by(F.get(f, F.lit(4)), "n").alias("entity")).drop("k")


def forum_offsets(df: DataFrame, by: str = "file") -> DataFrame:
    """Lines without a tag, with the number of characters before each: offsets count all lines with their ends, from -1."""
    rows = _summed(df, by, {"offset": F.length("value") + 1}, before=True)
    return rows.withColumn("offset", F.coalesce("offset", F.lit(0)) - 1).where("not value rlike '^<.*>$'")


def in_region(df: DataFrame, tags: tuple[str, ...] = ("TEXT", "HEADLINE"), by: str = "file") -> DataFrame:
    """Lines between a line <TAG> and a line </TAG>."""
    names = "|".join(tags)
    opened = F.col("value").rlike(f"^<({names})>$").cast("int") - F.col("value").rlike(f"^</({names})>$").cast("int")
    return _summed(df, by, {"depth": opened}).where("depth > 0 and not value rlike '^<.*>$'").drop("depth")


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, SENTENCE_END), lambda s: F.trim(s)), lambda s: s != "")


def cross_links(df: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """n, value (two header lines, then a title for each language, blank: missing) -> a column for each language."""
    f = F.split("value", "\t")
    return df.where("n >= 2").select(*[F.nullif(F.get(f, F.lit(i)), F.lit("")).alias(x) for i, x in enumerate(languages)])


def lexicon(df: DataFrame, separator: str = " ") -> DataFrame:
    """value ("word<tab>translations") -> word, translation; _ is a blank."""
    f = F.split("value", "\t")
    t = df.where(F.size(f) == 2).select(F.translate(f[0], "_", " ").alias("word"), F.explode(F.split(f[1], separator)).alias("translation"))
    return t.select("word", F.translate("translation", "_", " ").alias("translation")).where("translation <> ''")


def mention_counts(df: DataFrame) -> DataFrame:
    """value ("entity<tab>prior<tab>mention::=n...") -> entity, mention, cnt."""
    f = F.split("value", "\t")
    each = df.select(f[0].alias("entity"), F.explode(F.slice(f, 3, 1 << 30)).alias("m"))
    return each.select("entity", F.regexp_extract("m", "^(.*)::=(\\d+)$", 1).alias("mention"), F.regexp_extract("m", "::=(\\d+)$", 1).cast("long").alias("cnt")).where("cnt is not null")


def similarity_pairs(df: DataFrame, skip: int = 11) -> DataFrame:
    """value: tag, two words, score, after `skip` lines (column n, from 0) -> lower-cased words and score."""
    f = fields(F.col("value"))
    rows = df.where((F.col("n") >= skip) & (F.size(f) == 4))
    return rows.select("n", F.lower(f[1]).alias("w1"), F.lower(f[2]).alias("w2"), f[3].cast("double").alias("score"))


def phrase_pairs(df: DataFrame) -> DataFrame:
    """value: exactly two phrases -> lower-cased."""
    f = fields(F.col("value"))
    return df.where(F.size(f) == 2).select("n", F.lower(f[0]).alias("phrase1"), F.lower(f[1]).alias("phrase2"))


def context_pairs(df: DataFrame) -> DataFrame:
    """value: fields 5 and 6 are contexts with <b> before their target, field 7 the mean rating (counted from 0)."""
    f = fields(F.lower("value"))
    target = lambda c: F.regexp_extract(c, r"<b>\s*(\S+)", 1)
    return df.where(F.size(f) > 7).select("n", f[5].alias("context1"), f[6].alias("context2"), target(f[5]).alias("w1"), target(f[6]).alias("w2"), f[7].cast("double").alias("score"))


def related_pairs(df: DataFrame, vectors: DataFrame) -> DataFrame:
    """value: query, cand, whole-number label, where both ids have vectors (id)."""
    f = fields(F.col("value"))
    rows = df.where((F.size(f) == 3) & f[2].rlike("^-?[0-9]+$")).select(f[0].alias("query"), f[1].alias("cand"), f[2].cast("int").alias("label"))
    ids = vectors.select(F.col("id").cast("string").alias("id")).distinct()
    return rows.join(ids.withColumnRenamed("id", "query"), "query", "left_semi").join(ids.withColumnRenamed("id", "cand"), "cand", "left_semi").select("query", "cand", "label")


def kbp_xml(df: DataFrame, shift: int = 40) -> DataFrame:
    """doc, value (a whole file: DOC/TEXT/SEG with ORIGINAL_TEXT) -> doc, start (less `shift`), text of the segments that
    are no tag and no line of source or time."""
    starts, texts = F.xpath("value", F.lit("DOC/TEXT/SEG/@start_char")), F.xpath("value", F.lit("DOC/TEXT/SEG/ORIGINAL_TEXT/text()"))
    rows = df.select("doc", F.explode(F.arrays_zip(starts.alias("start"), texts.alias("text"))).alias("s"))
    kept = rows.select("doc", (F.col("s.start").cast("long") - shift).alias("start"), F.col("s.text").alias("text"))
    return kept.where("not text rlike '^\\\\s*(<.*>|(?i:source|time)\\\\s*:.*)\\\\s*$'")


def corpus_files(df: DataFrame, gold: DataFrame) -> DataFrame:
    """file, value: the lines of those files that have gold mentions; a file's document is its name without folders and ending."""
    doc = F.regexp_extract("file", r"([^/]+?)(?:\.[A-Za-z0-9]+)?$", 1)
    return df.withColumn("doc", doc).join(gold.select("doc").distinct(), "doc", "left_semi")


def rdf_links(df: DataFrame, predicate: str, wanted: DataFrame | None = None) -> DataFrame:
    """value: a triple of a knowledge base -> kb_id, wiki_id where the predicate's IRI ends so; wanted: wiki_id."""
    triple = r"^<[^>]*/(?:ns/)?([^/>]+)>\s+<[^>]*" + predicate + r">\s+\"([0-9]+)\""
    rows = df.select(F.regexp_extract("value", triple, 1).alias("kb_id"), F.regexp_extract("value", triple, 2).alias("wiki_id")).where("kb_id <> ''")
    rows = rows.select("kb_id", F.col("wiki_id").cast("long").alias("wiki_id"))
    return rows if wanted is None else rows.join(wanted, "wiki_id", "left_semi").select("kb_id", "wiki_id")
