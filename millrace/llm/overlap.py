"""Problem 2: the same or nearly the same records in evaluation and training splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.setjoin import CELL, run_sets, similar_classes


def cross_split_overlaps(records: DataFrame, threshold: float = 0.8, run: int = 5, sketch_bits: int | None = None, cell: int = CELL) -> tuple[DataFrame, DataFrame]:
    """Class pairs across the two sides, and the members of the classes.

    ``records`` has ``key`` string, ``is_train`` boolean and ``text``; other columns are ignored, so
    their names cannot clash. The join is bipartite: the rarest runs of the evaluation classes form
    the index, those of the training classes probe it, length and position filters drop what cannot
    reach the threshold, and the overlap of the rest is counted exactly. A run that many classes have in
    their prefix is met in cells of about ``cell`` postings a side.

    Returns ``(pairs, members)``: pairs ``a1, a2`` (class with evaluation members), ``b1, b2`` (class
    with training members) and ``similarity``, one row per pair of classes; a class with members on
    both sides is paired with itself. members: ``key, is_train, c1, c2``, distinct. Nothing is
    expanded to record pairs here; see :func:`record_pairs`.

    Null, empty and wordless texts are similar to nothing and null keys or sides are left out. A text
    with fewer than ``run`` words counts as one run. Repeated rows count once. Empty input gives empty
    results.
    """
    records = records.select("key", "is_train", "text").where("key is not null and is_train is not null")
    sets = run_sets(records, "text", ["key", "is_train"], run, name="overlap-sets")
    found = similar_classes(sets, threshold, "not is_train", "is_train", sketch_bits, cell)
    return found, sets.select("key", "is_train", "c1", "c2").distinct()


def record_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """``key_a < key_b, similarity``: each evaluation member of a pair's classes with each training member."""
    held = members.where("not is_train").select(F.col("c1").alias("a1"), F.col("c2").alias("a2"), F.col("key").alias("held_key"))
    train = members.where("is_train").select(F.col("c1").alias("b1"), F.col("c2").alias("b2"), F.col("key").alias("train_key"))
    return (
        pairs.join(held, ["a1", "a2"]).join(train, ["b1", "b2"]).where("held_key != train_key")
        .select(F.least("held_key", "train_key").alias("key_a"), F.greatest("held_key", "train_key").alias("key_b"), "similarity")
        .distinct()
    )


def overlap_report(pairs: DataFrame, members: DataFrame, info: DataFrame) -> DataFrame:
    """By ``split`` and ``source`` of the evaluation records: records, those with an overlap, those with an exact one.

    ``info`` has ``key, split, source``, one row per key; null sources count as one source.
    """
    hit = pairs.groupBy(F.col("a1").alias("c1"), F.col("a2").alias("c2")).agg(F.max("similarity").alias("best"))
    held = members.where("not is_train").join(hit, ["c1", "c2"], "left").groupBy("key").agg(F.max("best").alias("best"))
    return (
        info.join(held, "key")
        .groupBy("split", "source")
        .agg(F.count("*").alias("records"), F.count("best").alias("overlapping"), F.count_if(F.col("best") == 1.0).alias("exact"))
    )
