"""Validation and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dedup import duplicates, record_id

TOKEN_FIELDS = ["prompt_tokens", "completion_tokens", "total_tokens"]


def usage(df: DataFrame, column: str) -> DataFrame:
    """Sums of the token counts in a struct; nulls count as 0."""
    return df.agg(*(F.coalesce(F.sum(F.col(f"{column}.{f}")), F.lit(0)).alias(f) for f in TOKEN_FIELDS))


def nested_usage(df: DataFrame, rollouts: str, column: str = "token_usage") -> DataFrame:
    """The same over an array of structs: summed within the row, so nothing is exploded."""
    def total(field: str) -> Column:
        add = lambda s, r: s + F.coalesce(r[column][field], F.lit(0))
        return F.aggregate(F.coalesce(rollouts, F.array()), F.lit(0).cast("bigint"), add).alias(field)

    each = [total(f) for f in TOKEN_FIELDS]
    return df.select(*each).agg(*(F.coalesce(F.sum(f), F.lit(0)).alias(f) for f in TOKEN_FIELDS))


def sorted_values(column: str) -> Column:
    return F.array_join(F.array_sort(F.collect_set(column)), ",")


def release_manifest(pairs: DataFrame, quality: DataFrame) -> DataFrame:
    """One row of counts, settings, usage and acceptance; the rate is null for no rows."""
    made = pairs.agg(
        F.count("*").alias("rows"), F.count_distinct("parent_seed_id").alias("unique_parent_seeds"), sorted_values("generator_model").alias("generator_model"),
        sorted_values("prompt_version").alias("prompt_version"), sorted_values("reasoning_effort").alias("reasoning_effort"),
    )
    judged = quality.agg(
        sorted_values("solver_model").alias("solver_model"), F.count_if(F.coalesce("quality_accept", F.lit(False))).alias("quality_accept"),
        F.avg(F.coalesce("quality_accept", F.lit(False)).cast("double")).alias("quality_accept_rate"),
    )
    tokens = usage(pairs, "token_usage").toDF(*(f"generator_{f}" for f in TOKEN_FIELDS))
    solver = nested_usage(quality, "solver_rollouts").toDF(*(f"solver_{f}" for f in TOKEN_FIELDS))
    return made.crossJoin(judged).crossJoin(tokens).crossJoin(solver)  # one row each


def by_key(df: DataFrame, section: str, column: str) -> DataFrame:
    """``section, name, value``: rows for each value of a column, null as None."""
    return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("None")).alias("name")).agg(F.count("*").alias("value")).select(F.lit(section).alias("section"), "name", "value")


def as_section(row: DataFrame, section: str) -> DataFrame:
    """A one-row table of counts as ``section, name, value``."""
    pairs = F.map_from_arrays(F.array(*map(F.lit, row.columns)), F.array(*(F.col(f"`{c}`").cast("bigint") for c in row.columns)))
    return row.select(F.lit(section).alias("section"), F.explode(pairs).alias("name", "value"))


def invalid_records(lines: DataFrame, value: str, required: list[str]) -> DataFrame:
    """``problem, name, n`` of JSON lines: ids that repeat, and required keys that lines lack. Empty if the lines are valid.

    A record's id is its ``sample_id`` unless that is empty, else that of its ``extra_info``.
    """
    ids = duplicates(lines.select(record_id(F.get_json_object(value, "$.sample_id"), F.get_json_object(value, "$.extra_info.sample_id")).alias("id")), "id")
    lacking = missing_keys(lines, value, required).where("missing > 0")
    return ids.select(F.lit("repeated id").alias("problem"), F.col("id").alias("name"), "n").unionByName(lacking.select(F.lit("missing key").alias("problem"), F.col("key").alias("name"), F.col("missing").alias("n")))


def require_valid(invalid: DataFrame) -> None:
    """ValueError naming some of the rows of :func:`invalid_records`, if there are any."""
    if some := invalid.orderBy("problem", "name").limit(5).collect():
        raise ValueError("invalid records: " + ", ".join(f"{r['problem']} {r['name']} ({r['n']})" for r in some))


def missing_keys(lines: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """``key, missing``: JSON lines without each key. A key with a null value is present."""
    present = F.json_object_keys(value)
    counts = lines.agg(*(F.count_if(~F.coalesce(F.array_contains(present, k), F.lit(False))).alias(k) for k in keys))
    return counts.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, keys)), F.array(*(F.col(f"`{k}`") for k in keys)))).alias("key", "missing"))
