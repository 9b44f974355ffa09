"""Vocabularies: counts, pruning, ids, sampling rates and noise, pair merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.vectors import keep_rate

END = "</s>"


def counted(items: DataFrame, item: str = "item") -> DataFrame:
    return items.groupBy(item).agg(F.count("*").alias("cn"))


def word_counts(lines: DataFrame, words: Column) -> DataFrame:
    """item, cn of all words of all lines, and one END for each line."""
    return counted(lines.select(F.explode(F.concat(words, F.array(F.lit(END)))).alias("item")))


def graph_counts(edges: DataFrame) -> DataFrame:
    """item, cn of heads, once a row of (head, outs), and of their out-links."""
    return counted(edges.select(F.explode(F.concat(F.array("head"), "outs")).alias("item")))


def sense_counts(entities: DataFrame, anchors: DataFrame) -> DataFrame:
    """All of entities (item) with the number of anchors (item) on each, 0 allowed; others aren't counted."""
    return entities.select("item").join(counted(anchors), "item", "left").select("item", F.coalesce("cn", F.lit(0)).cast("long").alias("cn"))


def ranked(counts: DataFrame, least: int = 5, first: str | None = END) -> DataFrame:
    """Prunes items below `least` and numbers the others: `first` is 0, then by falling count, then by item.

    Only the different counts are sorted in one place (there are few); items are numbered within their count."""
    kept = counts.where((F.col("cn") >= least) | (F.col("item") == F.lit(first)))
    others = kept.where(F.col("item") != F.lit(first)) if first is not None else kept
    steps = others.groupBy("cn").agg(F.count("*").alias("n"))
    above = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("cn")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    steps = steps.select(F.col("cn").alias("_cn"), above.alias("above"))
    own = others.withColumn("k", F.row_number().over(Window.partitionBy("cn").orderBy("item")))
    offset = 0 if first is not None else -1
    out = own.join(steps, F.col("cn") == F.col("_cn")).select((F.col("above") + F.col("k") + offset).cast("long").alias("id"), "item", "cn")
    return out if first is None else out.union(kept.where(F.col("item") == F.lit(first)).select(F.lit(0).cast("long").alias("id"), "item", "cn"))


def with_rates(vocabulary: DataFrame, sample: float = 1e-4, power: float = 0.75) -> DataFrame:
    """keep: the chance to survive subsampling; noise: the chance to be drawn as a negative."""
    sums = vocabulary.agg(F.sum("cn").alias("total"), F.sum(F.pow("cn", F.lit(power))).alias("mass"))
    out = vocabulary.crossJoin(F.broadcast(sums))  # one row
    return out.select("id", "item", "cn", keep_rate(F.col("cn"), F.col("total"), sample).alias("keep"), (F.pow("cn", F.lit(power)) / F.col("mass")).alias("noise"))


def frequent(counts: DataFrame, k: int) -> DataFrame:
    return counts.orderBy(F.desc("cn"), "item").limit(k)


def lossy(counts: DataFrame, most: int) -> DataFrame:
    """Drops the rarest items, whole counts at a time, until at most `most` are left. Spark spills, so this
    is for bounded outputs only; it is exact where the original scheme is approximate."""
    steps = counts.groupBy("cn").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.orderBy(F.desc("cn")))
    kept = steps.withColumn("upto", total).where(F.col("upto") <= most).select("cn")
    return counts.join(kept, "cn", "left_semi")


def pair_counts(words: DataFrame) -> DataFrame:
    """words: symbols (array), cn. Adjacent symbol pairs, weighted."""
    rest = F.expr("slice(symbols, 2, size(symbols))")
    pairs = F.explode(F.expr("zip_with(slice(symbols, 1, size(symbols) - 1), slice(symbols, 2, size(symbols)), (a, b) -> struct(a, b))"))
    return words.where(F.size(rest) > 0).select(pairs.alias("p"), "cn").groupBy("p.a", "p.b").agg(F.sum("cn").alias("cn"))


def merge_pair(words: DataFrame, a: str, b: str) -> DataFrame:
    """Each a followed by b becomes one symbol, from left to right."""
    step = """aggregate(symbols, cast(array() as array<string>), (s, x) ->
      if(size(s) > 0 and element_at(s, -1) = '{a}' and x = '{b}',
         concat(slice(s, 1, size(s) - 1), array(concat('{a}', x))), concat(s, array(x))))"""
    quote = lambda s: s.replace("\\", "\\\\").replace("'", "\\'")
    return words.withColumn("symbols", F.expr(step.format(a=quote(a), b=quote(b))))


def learn_merges(words: DataFrame, n: int = 15) -> list[tuple[str, str, int]]:
    """The n most frequent pairs, one after the other merged; ends when none occurs twice. Ties: the smaller pair. Words are read
    once and kept in as many parts as they need, each round's until those of the next are there."""
    out, before = [], words.persist()
    held = before.coalesce(max(1, -(-before.count() // 50_000))).persist()
    for _ in range(n):
        best = pair_counts(held).orderBy(F.desc("cn"), "a", "b").first()
        before.unpersist()
        if best is None or best["cn"] < 2:
            break
        out.append((best["a"], best["b"], best["cn"]))
        before, held = held, merge_pair(held, best["a"], best["b"]).persist()
    before.unpersist()
    held.unpersist()
    return out


def cumulative(weights: DataFrame, group: str, order: str, weight: str) -> DataFrame:
    """cdf: the normalised running sum of weight within group."""
    w = Window.partitionBy(group)
    running = F.sum(weight).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return weights.withColumn("cdf", running / F.sum(weight).over(w))
