"""Exact ranks and running sums in groups of any size, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, group: list[str], bucket: Column, order: list[str], weight: str | None = None) -> DataFrame:
    """``df`` with ``rank`` (0 for the first of a group) and, given ``weight``, ``before`` (the sum of the earlier rows).

    ``bucket`` must not fall as ``order`` rises within a group. Rows are counted by (group, bucket),
    combined before the shuffle; the few counts are summed along each group; and rows are sorted only
    within their bucket.
    """
    keys = [*group, "_bucket"]
    rows = df.withColumn("_bucket", bucket)
    sums = [F.count("*").alias("_rows"), *([F.sum(weight).alias("_weight")] if weight else [])]
    counts = rows.groupBy(*keys).agg(*sums)
    along = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, *(F.coalesce(F.sum(c).over(along), F.lit(0)).alias(to) for c, to in (("_rows", "_rank0"), ("_weight", "_before0"))[: 1 + bool(weight)]))
    inside = Window.partitionBy(*keys).orderBy(*order)
    out = rows.join(offsets, keys).withColumn("rank", F.col("_rank0") + F.row_number().over(inside) - 1)
    if weight:
        earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn("before", F.col("_before0") + F.coalesce(F.sum(weight).over(earlier), F.lit(0)))
    return out.drop("_bucket", "_rank0", "_before0")


def permuted(seed: int, *columns: str) -> Column:
    """A keyed order of records: hexadecimal SHA-256, the same on every run and partitioning."""
    return F.sha2(F.concat_ws("\x1f", F.lit(str(seed)), *(F.col(c).cast("string") for c in columns)), 256)


def hash_bucket(order: str) -> Column:
    """4,096 buckets of a hexadecimal order."""
    return F.substring(order, 1, 3)
