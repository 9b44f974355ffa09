"""Evaluation sets: relatedness of entities, translations, similarity of word pairs and of senses in context."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import vectors as V

from . import ranking


def same_dimension(models: list[DataFrame]) -> int:
    """The dimension of all vectors of all models; an error where they differ."""
    sizes = {r["d"] for m in models for r in m.select(F.size("vec").alias("d")).distinct().limit(2).collect()}
    if len(sizes) > 1:
        raise ValueError(f"vectors of different dimensions: {sorted(sizes)}")
    return sizes.pop() if sizes else 0


def relatedness(pairs: DataFrame, vectors: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """pairs: query, cand, label; vectors: id, vec. For each query with two candidates at least, ranked by inner product (ties by
    cand): ap and ndcg at each k. Pairs of unknown ids are left out."""
    q, c = (vectors.select(F.col("id").alias(n), F.col("vec").alias(f"{n}_vec")) for n in ("query", "cand"))
    known = pairs.join(q, "query").join(c, "cand").withColumn("score", F.round(V.dot(F.col("query_vec"), F.col("cand_vec")), 9))
    own = Window.partitionBy("query")
    lists = known.withColumn("n", F.count("*").over(own)).where("n > 1")
    lists = lists.select("query", F.row_number().over(own.orderBy(F.desc("score"), "cand")).alias("rank"), F.col("label").alias("rel"))
    out = ranking.average_precision(lists)
    for k in ks:
        out = out.join(ranking.ndcg(lists, k).withColumnRenamed("ndcg", f"ndcg_{k}"), "query")
    return out


def translation_ranks(found: DataFrame, lexicon: DataFrame, n: int, k: int) -> DataFrame:
    """found: query, label, rank; lexicon: query, translation. For each query of the lexicon the best rank of any of its
    translations, without regard to case (n + 1 where none is found), and whether that is within k."""
    wanted = lexicon.select("query", F.lower("translation").alias("label")).distinct()
    hit = wanted.join(found.select("query", F.lower("label").alias("label"), "rank"), ["query", "label"], "left")
    best = hit.groupBy("query").agg(F.coalesce(F.min("rank"), F.lit(n + 1)).cast("long").alias("best"))
    return best.withColumn("hit", (F.col("best") <= k).cast("int"))


def phrase_vectors(phrases: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """phrases: id, phrase; vectors: label, vec. The mean vector of a phrase's known words; phrases without any are left out."""
    words = phrases.select("id", F.explode(F.split(F.lower("phrase"), " ")).alias("label")).join(vectors, "label")
    mean = F.array(*[F.avg(F.col("vec")[i].cast("double")) for i in range(dim)])
    return words.groupBy("id").agg(mean.alias("vec"))


def pair_similarity(pairs: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """pairs: id, phrase1, phrase2. Their scaled cosine; 0.5 where a phrase has no known word."""
    one, two = (phrase_vectors(pairs.select("id", F.col(f"phrase{k}").alias("phrase")), vectors, dim).withColumnRenamed("vec", f"v{k}") for k in (1, 2))
    both = pairs.select("id").join(one, "id", "left").join(two, "id", "left")
    return both.select("id", F.when(F.col("v1").isNotNull() & F.col("v2").isNotNull(), V.scaled_cosine(F.col("v1"), F.col("v2"))).otherwise(0.5).alias("similarity"))


def sense_similarity(senses: DataFrame) -> DataFrame:
    """senses: pair, side (1, 2), sense, weight (how well it fits the side's context), vec. For each pair avg_sim, the mean of all
    sense pairs' similarities by the product of their weights, and max_sim, that of the senses that fit best (ties by name).
    A pair without senses on a side is left out."""
    one, two = (senses.where(F.col("side") == k).select("pair", *[F.col(c).alias(f"{c}{k}") for c in ("sense", "weight", "vec")]) for k in (1, 2))
    both = one.join(two, "pair").withColumn("s", V.scaled_cosine(F.col("vec1"), F.col("vec2"))).withColumn("w", F.col("weight1") * F.col("weight2"))
    best = F.struct(F.col("weight1"), F.col("weight2"), F.col("sense1"), F.col("sense2"))
    return both.groupBy("pair").agg((F.sum(F.col("s") * F.col("w")) / F.sum("w")).alias("avg_sim"), F.max_by("s", best).alias("max_sim"))
