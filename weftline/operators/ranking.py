"""Measures of ranked lists and of agreement. A list is (query, rank from 1, rel)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.running import running
from weftline.functions.vectors import log2

def _query():
    """Built when it is used: a window needs a session."""
    return Window.partitionBy("query")


def reciprocal_rank(lists: DataFrame) -> DataFrame:
    """query, rr: 1 / the rank of the first relevant item, 0 without one."""
    return lists.groupBy("query").agg(F.coalesce(1 / F.min(F.when(F.col("rel") > 0, F.col("rank"))), F.lit(0.0)).alias("rr"))


def r_precision(lists: DataFrame) -> DataFrame:
    """The mean relevance up to the last relevant item."""
    last = lists.withColumn("last", F.max(F.when(F.col("rel") > 0, F.col("rank"))).over(_query()))
    value = F.avg(F.when(F.col("rank") <= F.col("last"), (F.col("rel") > 0).cast("int")))
    return last.groupBy("query").agg(F.coalesce(value, F.lit(0.0)).alias("r_precision"))


def precision_at(lists: DataFrame, k: int) -> DataFrame:
    """Null where a list is shorter than k."""
    value = F.sum(((F.col("rel") > 0) & (F.col("rank") <= k)).cast("int")) / k
    return lists.groupBy("query").agg(F.when(F.max("rank") >= k, value).alias("precision"))


def average_precision(lists: DataFrame) -> DataFrame:
    hits = F.sum((F.col("rel") > 0).cast("int")).over(_query().orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    value = F.avg(F.when(F.col("rel") > 0, F.col("hits") / F.col("rank")))
    return lists.withColumn("hits", hits).groupBy("query").agg(F.coalesce(value, F.lit(0.0)).alias("ap"))


def _gain(rel, rank, method: int):
    if method == 0:
        return F.when(rank == 1, rel * 1.0).otherwise(rel / log2(rank))
    return rel / log2(rank + 1)


def dcg(lists: DataFrame, k: int, method: int = 0) -> DataFrame:
    value = F.sum(F.when(F.col("rank") <= k, _gain(F.col("rel"), F.col("rank"), method)))
    return lists.groupBy("query").agg(F.coalesce(value, F.lit(0.0)).alias("dcg"))


def ndcg(lists: DataFrame, k: int, method: int = 0) -> DataFrame:
    """0 where the ideal is 0."""
    ideal = lists.withColumn("best", F.row_number().over(_query().orderBy(F.desc("rel"), "rank")))
    part = lambda rank: F.sum(F.when(F.col(rank) <= k, _gain(F.col("rel"), F.col(rank), method)))
    both = ideal.groupBy("query").agg(part("rank").alias("dcg"), part("best").alias("top"))
    return both.select("query", F.when(F.col("top") > 0, F.col("dcg") / F.col("top")).otherwise(0.0).alias("ndcg"))


def _average_ranks(seen: DataFrame, group: str, c: str, cuts: list[float]) -> DataFrame:
    """seen: group, c, n (rows). group, c, r: the mean rank of a value among the group's rows, by slices between the cuts."""
    from pyspark.ml.feature import Bucketizer

    counts = seen.groupBy(group, c).agg(F.sum("n").alias("m"))
    sliced = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol=c, outputCol="_s", handleInvalid="keep").transform(counts)
    below = running(sliced, [group], c, F.col("_s"), {"below": F.col("m")}, before=True)
    return below.select(F.col(group).alias(f"_{group}"), F.col(c).alias(f"_{c}"), (F.col("below") + (F.col("m") + 1) / 2.0).alias(f"r{c}"))


def spearman(pairs: DataFrame, group: str, x: str, y: str, slices: int = 256) -> DataFrame:
    """The correlation of average ranks; a missing value counts as 0. Ranks are those of distinct values, counted first; quantiles cut them
    in slices, so that a group isn't one task."""
    filled = pairs.select(group, F.coalesce(F.col(x).cast("double"), F.lit(0.0)).alias("x"), F.coalesce(F.col(y).cast("double"), F.lit(0.0)).alias("y"))
    seen = filled.groupBy(group, "x", "y").agg(F.count("*").alias("n"))
    ranked = seen
    for c, found in zip("xy", seen.approxQuantile(["x", "y"], [k / slices for k in range(1, slices)], 0.1 / slices)):
        r = _average_ranks(seen, group, c, sorted({k for k in found if math.isfinite(k)}) or [0.0])
        ranked = ranked.join(r, F.col(group).eqNullSafe(F.col(f"_{group}")) & (F.col(c) == F.col(f"_{c}"))).drop(f"_{group}", f"_{c}")
    sizes = seen.groupBy(F.col(group).alias("_g")).agg(((F.sum("n") + 1) / 2.0).alias("mean"))
    each = ranked.join(sizes, F.col(group).eqNullSafe(F.col("_g"))).select(group, "n", (F.col("rx") - F.col("mean")).alias("a"), (F.col("ry") - F.col("mean")).alias("b"))
    total = lambda p, q: F.sum(F.col("n") * F.col(p) * F.col(q))
    sums = each.groupBy(group).agg(total("a", "b").alias("ab"), (F.sqrt(total("a", "a")) * F.sqrt(total("b", "b"))).alias("d"))
    return sums.select(group, F.when(F.col("d") > 0, F.col("ab") / F.col("d")).alias("rho"))


def hits(candidates: DataFrame, k: int) -> DataFrame:
    """candidates: query, rank, good. Whether any of the first k is good."""
    return candidates.groupBy("query").agg(F.coalesce(F.bool_or(F.col("good") & (F.col("rank") <= k)), F.lit(False)).alias("hit"))


def best_rank(candidates: DataFrame, n: int) -> DataFrame:
    """The rank of the best good candidate, n + 1 without one."""
    return candidates.groupBy("query").agg(F.coalesce(F.min(F.when(F.col("good"), F.col("rank"))), F.lit(n + 1)).cast("long").alias("best"))


def precisions(predictions: DataFrame) -> DataFrame:
    """predictions: doc, good. micro: over all mentions; macro: the mean over documents."""
    docs = predictions.groupBy("doc").agg(F.sum(F.col("good").cast("int")).alias("tp"), F.count("*").alias("n"))
    return docs.agg((F.sum("tp") / F.sum("n")).alias("micro"), F.avg(F.col("tp") / F.col("n")).alias("macro"))


def first_in_group(rows: DataFrame, group: list[str], score: str, tie: str) -> DataFrame:
    """The row with the largest score in each group, ties by the smallest `tie`."""
    w = Window.partitionBy(*group).orderBy(F.desc(score), tie)
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def top(rows: DataFrame, key: str, k: int, largest: bool = True, tie: str | None = None) -> DataFrame:
    order = F.desc(key) if largest else F.asc(key)
    return rows.orderBy(order, *([tie] if tie else [])).limit(k)
