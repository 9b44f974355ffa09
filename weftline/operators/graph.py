"""Dictionaries, redirects, links across languages, candidates: joins that Catalyst plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def resolve(links: DataFrame, column: str, redirects: DataFrame) -> DataFrame:
    """column's redirect target (from, to) where there is one; one hop."""
    r = redirects.select(F.col("from").alias("_f"), F.col("to").alias("_t"))
    return links.join(r, F.col(column) == F.col("_f"), "left").withColumn(column, F.coalesce("_t", column)).drop("_f", "_t")


def outlinks(links: DataFrame, redirects: DataFrame, dictionary: DataFrame) -> DataFrame:
    """links: src, dst (titles) -> distinct src, dst (ids) whose both ends are known after redirects."""
    out = resolve(resolve(links, "src", redirects), "dst", redirects)
    for end in ("src", "dst"):
        ids = dictionary.select(F.col("title").alias(end), F.col("id").alias(f"{end}_id"))
        out = out.join(ids, end).drop(end)
    return out.select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst")).distinct()


def clean_redirects(pairs: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pairs: from, to; entities: title. Redirects whose target is an entity other than the source, and the
    entities without the sources. A target that is itself a source doesn't count (order matters not)."""
    sources = pairs.select(F.col("from").alias("title")).distinct()
    left = entities.join(sources, "title", "left_anti")
    kept = pairs.where("from <> to").join(left.select(F.col("title").alias("to")), "to", "left_semi")
    return kept.select("from", "to"), left


def casefold_redirects(titles: DataFrame, redirects: DataFrame) -> DataFrame:
    """from, to: the lower-case form of a title, where one title alone has it, it isn't a title or redirect itself."""
    low = titles.groupBy(F.lower("title").alias("from")).agg(F.count("*").alias("n"), F.first("title").alias("to"))
    low = low.where((F.col("n") == 1) & (F.col("from") != F.col("to"))).select("from", "to")
    return low.join(redirects.select("from"), "from", "left_anti").join(titles.select(F.col("title").alias("from")), "from", "left_anti")


def merge_links(files: list[DataFrame], languages: tuple[str, ...]) -> DataFrame:
    """Wide rows (a column a language) of several files in one: rows that agree in their first language that isn't
    missing are one; in each language the first file's value wins."""
    every = reduce(DataFrame.unionByName, [f.select(*languages, F.lit(i).alias("_o")) for i, f in enumerate(files)])
    key = F.coalesce(*[F.when(F.col(x).isNotNull(), F.concat(F.lit(f"{x}:"), F.col(x))) for x in languages])
    first = lambda x: F.min_by(x, F.when(F.col(x).isNotNull(), F.struct("_o", x)))
    return every.withColumn("_k", key).where("_k is not null").groupBy("_k").agg(*[first(x).alias(x) for x in languages]).drop("_k")


def sub_links(links: DataFrame, languages: tuple[str, ...]) -> DataFrame:
    """Rows that have two of these languages at least."""
    there = sum((F.col(x).isNotNull().cast("int") for x in languages), F.lit(0))
    return links.where(there > 1).select(*languages)


def link_slots(pairs: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """n, a, b -> slot, a, b: known ends only; an a has one slot, in the order of its first line, and its last b."""
    known = pairs.join(first.select(F.col("item").alias("a")), "a", "left_semi").join(second.select(F.col("item").alias("b")), "b", "left_semi")
    one = known.groupBy("a").agg(F.min("n").alias("n"), F.max_by("b", "n").alias("b"))
    return one.select((F.row_number().over(Window.orderBy("n")) - 1).alias("slot"), "a", "b")


def parallel_pairs(left: DataFrame, right: DataFrame, links: DataFrame) -> DataFrame:
    """article, entity, context of two languages, joined where both articles and both entities are linked (a, b)."""
    x = left.select(*[F.col(c).alias(f"{c}1") for c in ("article", "entity", "context")])
    y = right.select(*[F.col(c).alias(f"{c}2") for c in ("article", "entity", "context")])
    one = x.join(links.select(F.col("a").alias("article1"), F.col("b").alias("article2")), "article1")
    return one.join(links.select(F.col("a").alias("entity1"), F.col("b").alias("entity2")), "entity1").join(y, ["article2", "entity2"])


def candidates(mentions: DataFrame, sources: list[DataFrame]) -> DataFrame:
    """Distinct (mention, entity) of all sources, for these mentions."""
    every = reduce(DataFrame.unionByName, [s.select("mention", "entity") for s in sources])
    return every.join(mentions.select("mention").distinct(), "mention", "left_semi").distinct()


def with_links(rows: DataFrame, links: DataFrame) -> DataFrame:
    """entity's counterpart in the other language; empty without one."""
    k = links.select(F.col("a").alias("entity"), F.col("b").alias("linked"))
    return rows.join(k, "entity", "left").withColumn("linked", F.coalesce("linked", F.lit("")))


def translated(cands: DataFrame, translations: DataFrame) -> DataFrame:
    """Mentions of another language get the candidates of their translation (mention, english)."""
    return translations.join(cands.select(F.col("mention").alias("english"), "entity"), "english").select("mention", "entity").distinct()


def title_candidates(titles: DataFrame, mentions: DataFrame, entities: DataFrame) -> DataFrame:
    t = titles.select(F.lower("title").alias("mention"), F.col("id").alias("entity"))
    return t.join(mentions.select("mention"), "mention", "left_semi").join(entities.select("entity"), "entity", "left_semi").distinct()


def with_gold(cands: DataFrame, gold: DataFrame, vectors: DataFrame) -> DataFrame:
    """mention_id, entity: candidates that have a vector, of mentions whose gold entity is one of them."""
    kept = cands.join(vectors.select("entity"), "entity", "left_semi").join(gold.select("mention_id", F.col("entity").alias("gold")), "mention_id")
    has = F.max((F.col("entity") == F.col("gold")).cast("int")).over(Window.partitionBy("mention_id"))
    return kept.withColumn("has", has).where("has = 1").drop("has")


def coverage(mentions: DataFrame, cands: DataFrame, group: Column) -> DataFrame:
    """For each group: mentions, those with candidates, and those whose gold entity is a candidate."""
    m = mentions.select(group.alias("g"), "mention", "entity")
    known = cands.select("mention").where("mention is not null").distinct().withColumn("there", F.lit(1))
    asked = m.groupBy("g", "mention").agg(F.count("*").alias("n")).join(known, "mention", "left")  # one row a group and mention
    gold = m.join(cands.select("mention", "entity").distinct(), ["mention", "entity"], "left_semi")
    sums = asked.select("g", "n", F.when(F.col("there") == 1, F.col("n")).otherwise(0).alias("c"), F.lit(0).alias("e")).unionByName(gold.select("g", F.lit(0).alias("n"), F.lit(0).alias("c"), F.lit(1).alias("e")))
    return sums.groupBy("g").agg(F.sum("n").alias("n"), F.sum("c").alias("with_candidates"), F.sum("e").alias("with_gold"))


def priors(counts: DataFrame) -> DataFrame:
    """entity, mention, cnt -> p(entity | mention) as pem, and the entity's share of all counts in percent as pe."""
    by_entity = counts.groupBy("entity").agg(F.sum("cnt").alias("n"))
    total = by_entity.agg(F.sum("n").alias("total"))
    pe = by_entity.crossJoin(F.broadcast(total)).select("entity", (F.col("n") / F.col("total") * 100).alias("pe"))  # one row
    return counts.withColumn("pem", F.col("cnt") / F.sum("cnt").over(Window.partitionBy("mention"))).join(pe, "entity")


def interleaved(pairs: DataFrame) -> DataFrame:
    """key, first, second (arrays) -> key, i, value: each element of the shorter list, then the next `ratio` of the
    longer (ratio: the lengths' quotient, rounded down); the second is the longer one if both are equally long."""
    long_first = F.size("first") > F.size("second")
    p = pairs.select("key", F.when(long_first, F.col("second")).otherwise(F.col("first")).alias("s"), F.when(long_first, F.col("first")).otherwise(F.col("second")).alias("l")).where("size(s) > 0")
    p = p.withColumn("r", F.expr("cast(greatest(size(l) div size(s), 1) as int)"))
    mixed = F.expr("flatten(transform(s, (x, i) -> concat(array(x), slice(l, i * r + 1, r))))")
    return p.select("key", F.posexplode(mixed).alias("i", "value"))


def gold_dictionary(mentions: DataFrame, language: Column) -> DataFrame:
    """mentions: doc, mention, entity; language: from doc. The distinct entities of each mention, by language."""
    return mentions.groupBy(language.alias("lang"), "mention").agg(F.array_sort(F.collect_set("entity")).alias("entities"))


def candidate_totals(cands: DataFrame) -> DataFrame:
    """mention, entity -> the number of mentions and of their distinct entities."""
    each = cands.groupBy("mention").agg(F.count_distinct("entity").alias("n"))
    return each.agg(F.count("*").alias("mentions"), F.coalesce(F.sum("n"), F.lit(0)).alias("candidates"))


def redirect_candidates(redirects: DataFrame, dictionary: DataFrame) -> DataFrame:
    """redirects: from, to (titles); dictionary: title, id. A redirect's title is a mention of where it leads."""
    known = dictionary.select(F.col("title").alias("to"), F.col("id").alias("entity"))
    return redirects.join(known, "to").select(F.lower("from").alias("mention"), "entity").distinct()


def linked_pages(pages: DataFrame, titles: DataFrame) -> DataFrame:
    """Pages whose title is one of the cross-linked ones (title)."""
    return pages.join(titles.select("title").distinct(), "title", "left_semi")


def paired_sizes(pairs: DataFrame) -> DataFrame:
    """lang, sentences1, sentences2 -> for each lang the pairs with sentences on both sides."""
    return pairs.groupBy("lang").agg(F.count_if((F.size("sentences1") > 0) & (F.size("sentences2") > 0)).alias("n"))
