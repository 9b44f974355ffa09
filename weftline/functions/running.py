"""Running sums over long ordered groups, without a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(df: DataFrame, by: list[str], order: str, cell: Column, sums: dict[str, Column], before: bool = False) -> DataFrame:
    """df with the running sum of each of `sums` within `by`, in the order of a column; before: of the rows before.

    cell numbers slices of a group and must not fall as the order rises. A window sees one slice, which begins with a row of
    what all slices before it sum up to; only these rows, one a slice, are in one place."""
    rows = df.withColumns({"_cell": cell, **sums}).withColumn("_row", F.lit(1))
    totals = rows.groupBy(*by, "_cell").agg(*[F.sum(c).alias(c) for c in sums])
    earlier = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(*by, "_cell", F.lit(0).alias("_row"), *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in sums])
    own = Window.partitionBy(*by, "_cell").orderBy("_row", order)
    own = own.rowsBetween(Window.unboundedPreceding, -1) if before else own
    both = rows.unionByName(bases, allowMissingColumns=True)
    return both.withColumns({c: F.sum(c).over(own) for c in sums}).where("_row = 1").drop("_row", "_cell")
