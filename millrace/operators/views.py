"""Nested replacement views: training records in which a growing share of real problems is replaced."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.records import arm_name, audited_records, rlvr_record, sft_record
from .sampling import in_ratio, nested_positions

RATIOS = [0.0, 0.25, 0.5, 0.75, 1.0]


def check_rows(rows: DataFrame, key: str = "parent_seed_id", expected: int = 0, required: tuple[str, ...] = ()) -> None:
    """ValueError for missing columns, a key that repeats, or another number of rows than expected (0: any)."""
    if missing := sorted(set(required) - set(rows.columns)):
        raise ValueError(f"missing columns: {missing}")
    n, keys = rows.agg(F.count("*"), F.count_distinct(key)).first()
    if keys != n:
        raise ValueError(f"{key} is null or repeats: {n} rows, {keys} keys")
    if expected and n != expected:
        raise ValueError(f"{n} rows where {expected} are expected")


def rlvr_views(rows: DataFrame, seed: int, ratios: list[float] = RATIOS) -> DataFrame:
    """Every row once for each ratio's arm and once for ``fallback`` (synthetic where accepted, nominal ratio -1).

    One pass: positions are computed once and each row is exploded over the few arms.
    """
    arms = F.array(*(F.lit(float(r)) for r in [*ratios, -1.0]))
    each = nested_positions(rows, "parent_seed_id", ["source", "problem_type"], seed).withColumn("_ratio", F.explode(arms))
    fallback = F.col("_ratio") < 0
    synthetic = F.when(fallback, F.coalesce("quality_accept", F.lit(False))).otherwise(in_ratio(F.col("_ratio")))
    each = each.withColumns({"_synthetic": synthetic, "_arm": F.when(fallback, "fallback").otherwise(arm_name("_ratio"))})
    return each.select(*rlvr_record(F.col("_synthetic"), F.col("_arm"), F.col("_ratio")))


def sft_views(rows: DataFrame) -> DataFrame:
    """Supervised records of the arms real, raw_synthetic and fallback, with ``arm``."""
    each = rows.withColumn("_arm", F.explode(F.array(F.lit("real"), F.lit("raw_synthetic"), F.lit("fallback"))))
    synthetic = F.when(F.col("_arm") == "fallback", F.coalesce("quality_accept", F.lit(False))).otherwise(F.col("_arm") == "raw_synthetic")
    each = each.withColumn("_synthetic", synthetic)
    return each.select(*sft_record(F.col("_synthetic"), F.col("_arm")), F.col("_arm").alias("arm"))


def arm_counts(views: DataFrame) -> DataFrame:
    info = views.select("extra_info.*")
    return info.groupBy("arm", "source").agg(F.count("*").alias("rows"), F.count_if(F.col("origin") == "synthetic").alias("synthetic"))


def view_manifest(views: DataFrame) -> DataFrame:
    """``section, name, value`` of all arms: rows, synthetic ones, and rows by source, null as None."""
    info = views.select("extra_info.*")
    counts = info.groupBy("arm").agg(F.count("*").alias("rows"), F.count_if(F.col("origin") == "synthetic").alias("synthetic"))
    each = counts.select(F.concat(F.lit("arms."), "arm").alias("section"), F.explode(F.create_map(F.lit("rows"), F.col("rows"), F.lit("synthetic"), F.col("synthetic"))).alias("name", "value"))
    sources = info.where("arm != 'fallback'").groupBy("arm", F.coalesce("source", F.lit("None")).alias("name")).agg(F.count("*").alias("value"))
    return each.unionByName(sources.select(F.format_string("arms.%s.by_source", "arm").alias("section"), "name", "value"))


def with_group(rows: DataFrame) -> DataFrame:
    """Adds ``experimental_group`` to audited rows: a human verdict first, then unanimous automatic votes."""
    valid, correct = F.col("human_audit.question_valid"), F.col("human_audit.reference_answer_correct")
    automatic = F.coalesce("auto_unanimous_valid", F.lit(False)) & F.coalesce("auto_majority_reference_correct", F.lit(False))
    group = F.when(valid & correct, "valid_correct").when(~valid, "invalid_pseudo").when(automatic, "auto_verified").otherwise("raw_unverified")
    return rows.withColumn("experimental_group", group)


def audited_datasets(rows: DataFrame, name: str = "audited_math") -> dict[str, DataFrame]:
    """The supervised, reinforcement and invalid-only datasets of grouped rows."""
    kinds = audited_records(name)
    return {"sft": rows.select(*kinds["sft"]), "rlvr": rows.select(*kinds["rlvr"]), "invalid_eval": rows.where("human_audit.question_valid = false")}
