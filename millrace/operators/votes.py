"""Aggregates over votes and rollouts, which are arrays of structs or exploded rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.answers import answer_matches, declared_invalid, regime, regime_probabilities


def vote_summary(votes: DataFrame, key: str, expected: int) -> DataFrame:
    """Per key: counts, majority, unanimity and most frequent kind of ``expected`` votes.

    ``votes`` has ``vote``, ``question_valid``, ``reference_answer_correct`` and ``invalid_type``. Majority is more than
    half, unanimity all, of the expected number, not of the rows received. Ties of kinds go to the one voted first.
    """
    kinds = votes.groupBy(key, "invalid_type").agg(
        F.count("*").alias("n"), F.min("vote").alias("first"), F.count_if("question_valid").alias("valid"), F.count_if("reference_answer_correct").alias("correct")
    )
    return kinds.groupBy(key).agg(
        F.sum("valid").alias("auto_valid_votes"), F.sum("correct").alias("auto_reference_correct_votes"),
        F.min_by("invalid_type", F.struct(-F.col("n"), "first")).alias("auto_invalid_type"),
    ).withColumns({
        "auto_majority_valid": F.col("auto_valid_votes") > expected / 2, "auto_unanimous_valid": F.col("auto_valid_votes") == expected,
        "auto_majority_reference_correct": F.col("auto_reference_correct_votes") > expected / 2,
    })


def collected(rows: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """``key`` and an array of its rows' other columns, ordered."""
    rest = [c for c in rows.columns if c not in (key, order)]
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *rest))).alias(name))


def rollout_matches(rollouts: str | Column, answer: str | Column) -> Column:
    """Rollouts in an array whose prediction matches the answer; 0 for a null array."""
    rollouts = F.col(rollouts) if isinstance(rollouts, str) else rollouts
    return F.coalesce(F.size(F.filter(F.coalesce(rollouts, F.array()), lambda r: answer_matches(r["prediction"], answer))), F.lit(0))


def rollouts_declared_invalid(rollouts: str | Column) -> Column:
    rollouts = F.col(rollouts) if isinstance(rollouts, str) else rollouts
    return F.size(F.filter(rollouts, lambda r: declared_invalid(r["prediction"])))


def reachability(rows: DataFrame, matches: Column, k: int) -> DataFrame:
    """Adds the match count, its rate, the regime it shows and the chances of each regime."""
    out = rows.withColumn("pseudo_answer_matches", matches).withColumn("pseudo_answer_p_hat", F.col("pseudo_answer_matches") / k)
    chances = regime_probabilities("pseudo_answer_p_hat", k)
    names = ["predicted_dead_probability", "predicted_active_probability", "predicted_saturated_probability"]
    return out.withColumn("observed_group_regime", regime("pseudo_answer_matches", k)).withColumns(dict(zip(names, chances)))


def regime_grid(spark, sizes: list[int], rates: list[float]) -> DataFrame:
    """``k, p, dead, active, saturated`` for every pair."""
    ks, ps = spark.createDataFrame([(k,) for k in sizes], "k int"), spark.createDataFrame([(p,) for p in rates], "p double")
    return ks.crossJoin(F.broadcast(ps)).select("k", "p", *regime_probabilities("p", "k"))
