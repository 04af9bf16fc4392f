"""Connected components of links between records, in Spark jobs only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import join_counted
from ..operators.staging import drop_stage, stage


def connected_components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """``id, root``: for each record in ``links`` the smallest id of its component.

    Alternates large-star and small-star steps until no link changes, which takes a logarithmic number
    of rounds. Each round is a grouped minimum (combined before its shuffle) and a join in which a hub's links
    stay where they are (:func:`join_counted`), and its result is a written table; the one before is then deleted. Links with a null end and self-links are ignored; an empty table gives an empty one.
    """

    def star(edges: DataFrame, larger: bool, total: int) -> DataFrame:
        both = edges.select(F.col("u"), F.col("v"))
        if larger:
            both = both.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:
            both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        joined = join_counted(both, least, "u", "n", total)
        if larger:
            return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        own = least.select("u", F.col("m").alias("v"))
        return joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own).where("u != v").distinct()

    start = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"`{a}` is not null and `{b}` is not null and `{a}` != `{b}`")
    edges = stage(start.distinct(), "links")
    n, before = edges.count(), None
    for _ in range(most_rounds):
        last, edges = edges, stage(star(star(edges, True, 2 * n), False, 2 * n), "links")  # a star has no more links than it was given, both ways
        drop_stage(last)
        sums = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if sums == before:
            break
        n, before = sums[0], sums
    else:
        raise RuntimeError("connected_components did not settle")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
