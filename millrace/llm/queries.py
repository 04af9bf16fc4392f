"""The registered queries of the subpackage; each runs over its whole tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import epochs, leakage, mixing, overlap, pairs, pivots, proportions, repetition, spans


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tidy(c: str | Column) -> Column:
    return F.lower(F.trim(c))


# Problem 1


def _seed_sample(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    seeds = table(spark, sf, "numina_5k_seeds")
    size = seeds.agg(F.count_distinct("parent_seed_id")).first()[0] // 5
    return proportions.sample_to_targets(seeds.select(F.col("parent_seed_id").alias("id"), "source", "problem_type"), table(spark, sf, "seed_targets"), ["source", "problem_type"], size)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return _seed_sample(spark, sf)[1].where("short > 0").select("source", "problem_type")


def p1_sample(spark: SparkSession, sf: str) -> DataFrame:
    return _seed_sample(spark, sf)[0].withColumnRenamed("id", "parent_seed_id")


def p1_report(spark: SparkSession, sf: str) -> DataFrame:
    return _seed_sample(spark, sf)[1]


# Problem 2


def _split_records(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Records ``key, is_train, text`` of problem 2, and ``key, split, source`` of the evaluation ones."""
    seeds, generated = table(spark, sf, "numina_5k_seeds"), table(spark, sf, "gpt_pairs")
    parents = seeds.groupBy(F.trim("parent_seed_id").alias("parent")).agg(F.min(tidy("split")).alias("split"), F.min(tidy("source")).alias("source")).where("split != ''")
    seed_rows = seeds.select(F.col("parent_seed_id").alias("key"), F.trim("parent_seed_id").alias("parent"), F.col("real_problem").alias("text"))
    pair_rows = generated.select(F.col("sample_id").alias("key"), F.trim("parent_seed_id").alias("parent"), F.col("synthetic_problem").alias("text"))
    both = seed_rows.unionByName(pair_rows)
    records = both.join(parents, "parent").select("key", (F.col("split") == "train").alias("is_train"), "text")
    info = both.select("key", "parent").distinct().join(parents.where("split != 'train'"), "parent").groupBy("key").agg(F.min("split").alias("split"), F.min("source").alias("source"))
    return records, info


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    linked, members = overlap.cross_split_overlaps(_split_records(spark, sf)[0], threshold=0.6)
    return overlap.record_pairs(linked, members).select("key_a", "key_b")


def p2_report(spark: SparkSession, sf: str) -> DataFrame:
    records, info = _split_records(spark, sf)
    linked, members = overlap.cross_split_overlaps(records, threshold=0.8)
    return overlap.overlap_report(linked, members, info)


# Problem 3


def _quality_problems(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "gpt_pairs_quality").select(F.col("sample_id").alias("key"), F.col("synthetic_problem").alias("text"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    near = pivots.near_duplicates(_quality_problems(spark, sf), threshold=0.6)
    return pivots.record_pairs(near.pairs, near.members).select(F.col("a").alias("sample_a"), F.col("b").alias("sample_b"))


def p3_groups(spark: SparkSession, sf: str) -> DataFrame:
    near = pivots.near_duplicates(_quality_problems(spark, sf), threshold=0.8)
    return pivots.groups(near.pairs, near.members).select(F.col("key").alias("sample_id"), "group_id", "copies", "links")


def p3_pruning(spark: SparkSession, sf: str) -> DataFrame:
    """What the pivot tables discard at the threshold of p3_found."""
    return pivots.near_duplicates(_quality_problems(spark, sf), threshold=0.6).pruning()


# Problem 4

#: Share of new parents taken in each month of generation, and in any other or without a time.
EPOCH_RATES, OTHER_RATE = {"2026-01": 0.5, "2026-02": 0.4, "2026-03": 0.3}, 0.2


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    seen = table(spark, sf, "rlvr").select(
        F.col("extra_info.parent_seed_id").alias("id"), F.col("extra_info.synthetic_ratio").alias("rate"),
        F.when(F.col("extra_info.origin") == "synthetic", True).when(F.col("extra_info.origin") == "real", False).alias("selected"),
    )
    return epochs.broken_nesting(seen).select(F.col("id").alias("parent_seed_id"))


def p4_selection(spark: SparkSession, sf: str, rates: dict[str, float] = EPOCH_RATES, other: float = OTHER_RATE) -> DataFrame:
    """The table's selected parents. Each run registers what has come to it since the last; the state is kept for each table's path.

    The rates are those of this run: they count for parents it registers, known ones keep theirs.
    """
    parents = table(spark, sf, "gpt_pairs").select(F.trim("parent_seed_id").alias("id"), F.substring("generated_at", 1, 7).alias("epoch"))
    rate = F.lit(other)
    for month, share in rates.items():
        rate = F.when(F.col("epoch") == month, share).otherwise(rate)
    state = epochs.register_kept(parents, rate, f"p4-{hashlib.sha256(sf.rstrip('/').encode()).hexdigest()[:16]}")
    chosen = epochs.select(state).where("selected").join(parents.select("id").distinct(), "id", "left_semi")
    return chosen.select(F.col("id").alias("parent_seed_id"), "epoch", "rate")


# Problem 5


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "gpt_pairs").select(
        F.col("sample_id").alias("key"), F.col("synthetic_problem").alias("problem"), F.col("synthetic_solution").alias("solution"), F.col("synthetic_answer").alias("answer")
    )
    return pairs.broken_pairs(rows, table(spark, sf, "documents")).withColumnRenamed("key", "sample_id")


# Problem 6


def _repetition_texts(spark: SparkSession, sf: str) -> DataFrame:
    made = table(spark, sf, "gpt_pairs").select(F.col("sample_id").alias("key"), F.lit("synthetic_solution").alias("field_name"), F.col("synthetic_solution").alias("text"))
    solved = table(spark, sf, "gpt_pairs_solved").select(F.col("sample_id").alias("key"), F.lit("raw_response").alias("field_name"), F.col("raw_response").alias("text"))
    return made.unionByName(solved)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = repetition.repeated_content(_repetition_texts(spark, sf), share=0.4, least_words=20)
    return rows.where("possible and run_share >= 0.4").select(F.col("key").alias("sample_id"), "field_name").distinct()


def p6_shares(spark: SparkSession, sf: str) -> DataFrame:
    rows = repetition.repeated_content(_repetition_texts(spark, sf), share=0.4, least_words=20)
    return rows.select(F.col("key").alias("sample_id"), "field_name", "words", "run_share", "sentence_share", "line_share").distinct()


def p6_anomalies(spark: SparkSession, sf: str) -> DataFrame:
    """Texts that the forest, by the calibrated threshold, calls anomalous."""
    rows = repetition.repeated_content(_repetition_texts(spark, sf), share=0.4, least_words=20)
    return rows.where("anomalous").select(F.col("key").alias("sample_id"), "field_name", "path", "run_share").distinct()


def p6_calibration(spark: SparkSession, sf: str) -> DataFrame:
    return repetition.calibration(repetition.repeated_content(_repetition_texts(spark, sf), share=0.4, least_words=20))


# Problem 7


def _leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaked_items(table(spark, sf, "documents"), table(spark, sf, "eval_questions"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return _leaks(spark, sf).where("score * words >= least(12, words) - 1e-9").where("run >= least(12, words)").select("doc_id", "eval_id")


def p7_aligned(spark: SparkSession, sf: str) -> DataFrame:
    return _leaks(spark, sf)


# Problem 8


def _mix(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix_sources(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf)[1].where("short").select("source")


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf)[0]


def p8_report(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf)[1]


# Problem 9


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return spans.shared_spans(table(spark, sf, "documents")).where("shared_chars > 0").select("doc_id")


def p9_shared(spark: SparkSession, sf: str) -> DataFrame:
    return spans.shared_spans(table(spark, sf, "documents"))


_ALL = [
    p1_found, p1_sample, p1_report, p2_found, p2_report, p3_found, p3_groups, p3_pruning, p4_found, p4_selection, p5_found,
    p6_found, p6_shares, p6_anomalies, p6_calibration, p7_found, p7_aligned, p8_found, p8_mix, p8_report, p9_found, p9_shared,
]
QUERIES = {f.__name__: f for f in _ALL}

