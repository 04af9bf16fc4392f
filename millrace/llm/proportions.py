"""Problem 1: a sample that matches target proportions over a tree of categories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranks import hash_bucket, permuted, ranked
from ..operators.staging import stage


def allocate(leaves: DataFrame, levels: list[str]) -> DataFrame:
    """Adds ``drawn`` and ``unmet`` to leaf categories with ``quota`` and ``available``.

    A leaf first fills its own quota. From the leaves' parents up to the root, what a node's leaves
    could not fill goes to those of them with rows to spare, in proportion to what they can spare,
    so siblings come before cousins. Integer parts come from differences of running floors, so no leaf
    gets more than it has and nothing is lost to rounding. Works on one row per category only; at the root
    all categories are in one task.
    """
    out = leaves.withColumn("drawn", F.least("quota", "available")).withColumn("unmet", F.col("quota") - F.col("drawn"))
    part = "cast({g} as decimal(19,0)) * cast({c} as decimal(19,0)) div cast(greatest({s}, 1) as decimal(19,0))"
    for depth in range(len(levels) - 1, -1, -1):
        node = Window.partitionBy(*(levels[:depth] or [F.lit(0)]))
        along = node.orderBy(*levels).rowsBetween(Window.unboundedPreceding, 0)
        out = (
            out.withColumn("_spare", F.col("available") - F.col("drawn"))
            .withColumn("_u", F.sum("unmet").over(node)).withColumn("_s", F.sum("_spare").over(node)).withColumn("_give", F.least("_u", "_s"))
            .withColumn("_cu", F.sum("unmet").over(along)).withColumn("_cs", F.sum("_spare").over(along))
            .withColumn("drawn", F.col("drawn") + F.expr(part.format(g="_give", c="_cs", s="_s")) - F.expr(part.format(g="_give", c="(_cs - _spare)", s="_s")))
            .withColumn("unmet", F.col("unmet") - F.expr(part.format(g="_give", c="_cu", s="_u")) + F.expr(part.format(g="_give", c="(_cu - unmet)", s="_u")))
            .drop("_spare", "_u", "_s", "_give", "_cu", "_cs")
        )
    return out


def sample_to_targets(records: DataFrame, targets: DataFrame, levels: list[str], size: int, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(sample, report) of about ``size`` records in the proportions of ``targets``.

    ``records`` has ``id`` and the columns ``levels``, from the root of the category tree down;
    ``targets`` has ``levels``, ``target_share`` and ``min_rows``. Categories are compared after trimming
    and lower-casing. A category's quota is the larger of ``min_rows`` and the rounded share of ``size``;
    see :func:`allocate` for quotas that cannot be met. At the leaves the records with the lowest
    permuted dense ranks are drawn, so the draw does not depend on order or partitioning.

    sample: ``id``, the normalised ``levels`` and ``rank``, a written table. report: one row per target category
    as written there, with ``quota``, ``available``, and, counted from the sample, ``drawn`` and ``short`` (the
    quota less the records drawn for it), and ``unmet`` (its part of what no category could replace).

    Repeated rows of an id count once; an id in several target categories belongs to the first by
    name. Null ids, null categories and categories without a target are not drawn. Null shares and
    minima count as 0; repeated target rows count once. Empty tables give an empty sample.
    """
    norm = [F.lower(F.trim(c)).alias(c) for c in levels]
    goals = targets.select(*(F.col(c).alias(f"_as_{c}") for c in levels), *norm, F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("min_rows", F.lit(0)).alias("min_rows")).distinct()
    quota = F.greatest(F.col("min_rows").cast("bigint"), F.floor(F.col("target_share") * size + 0.5))
    known = records.select("id", *norm).where(" and ".join(f"`{c}` is not null" for c in ["id", *levels]))
    wanted = known.join(goals.select(*levels), levels, "left_semi").groupBy("id").agg(F.min(F.struct(*levels)).alias("leaf")).select("id", "leaf.*")
    have = wanted.groupBy(*levels).agg(F.count("*").alias("available"))
    leaves = goals.withColumn("quota", quota).join(have, levels, "left").fillna(0, ["available"])
    plan = allocate(leaves, levels)
    order = wanted.withColumn("_order", permuted(seed, "id"))
    plan = stage(plan, "allocation")
    goal = plan.groupBy(*levels).agg(F.max("drawn").alias("_drawn"))  # targets may name a category twice
    sample = ranked(order, levels, hash_bucket("_order"), ["_order", "id"]).join(goal, levels).where("rank < _drawn").select("id", *levels, "rank")
    sample = stage(sample, "sample")
    counts = sample.groupBy(*levels).agg(F.count("*").alias("_got"))
    got = F.coalesce("_got", F.lit(0))
    report = plan.drop("drawn").join(counts, levels, "left").select(
        *(F.col(f"_as_{c}").alias(c) for c in levels), "target_share", "min_rows", "quota", "available", got.alias("drawn"), F.greatest(F.col("quota") - got, F.lit(0)).alias("short"), "unmet"
    )
    return sample, report
