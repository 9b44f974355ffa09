"""Connected components as DataFrame joins."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_unique, stage


#: Edges (16 bytes each) that one task takes at once; more of them are first drawn together by rounds.
ONE_TASK = 500_000


def _in_one(edges: pd.DataFrame) -> pd.DataFrame:
    """The smallest node that each node reaches: labels go along edges and are followed until nothing changes."""
    nodes, ends = np.unique(edges[["a", "b"]].to_numpy(np.int64), return_inverse=True)
    a, b = ends.reshape(-1, 2).T
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return pd.DataFrame({"a": nodes, "to": nodes[label]})
        label = new


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """edges: a, b (long). Out: node, root for each node of an edge; nodes share a root if and only if
    a path joins them.

    Up to `one_task` edges are joined in one task. While there are more, each round, every node goes to the neighbour (or itself) that has the smallest hash of that
    round, and edges are redrawn between the nodes that are left. A constant part of the nodes
    goes in each round, so that their number is logarithmic, also on long paths. A node with very
    many edges is counted before the shuffle and its edges are spread.
    """
    left = stage(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    moves: list[DataFrame] = []
    while left.count() > one_task:
        turn = len(moves)
        both = left.union(left.select("b", "a"))
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("p"), F.col(c).alias("v"))
        step = both.groupBy("a").agg(F.min(rank("b")).alias("least"), F.count("*").alias("w"))
        step = stage(step.select("a", F.least("least", rank("a"))["v"].alias("to"), "w"), "moves")
        one = join_unique(left, step.select("a", F.col("to").alias("to_a"), "w"), ["a"], "w").drop("w")
        two = join_unique(one, step.select(F.col("a").alias("b"), F.col("to").alias("to_b"), "w"), ["b"], "w")
        kept = two.where("to_a <> to_b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
        left = stage(kept.distinct(), "edges")
        moves.append(step.select("a", "to"))
    last = left.coalesce(1).mapInPandas(lambda batches: [_in_one(pd.concat([pd.DataFrame({"a": [], "b": []}, dtype="int64"), *batches]))], "a long, to long")
    moves.append(stage(last, "moves"))

    def follow(so_far: DataFrame, step: DataFrame) -> DataFrame:
        weights = so_far.groupBy("to").agg(F.count("*").alias("w"))
        next_ = step.select(F.col("a").alias("to"), F.col("to").alias("next")).join(weights, "to")
        return stage(join_unique(so_far, next_, ["to"], "w").select("a", F.coalesce("next", "to").alias("to")), "roots")

    return reduce(follow, moves).select(F.col("a").alias("node"), F.col("to").alias("root"))
