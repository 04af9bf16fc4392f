"""Similarity joins on the word shingles of normalised texts, with exact Jaccard verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import jaccard, normalize_text, shingles
from .setjoin import run_sets, similar_classes
from .staging import stage


def shingle_sets(df: DataFrame, key: str, text: str, size: int = 5) -> DataFrame:
    """A written table: ``key``, a 128-bit name of the normalised text (``t1, t2``), and its class and hashed shingles; ``n`` is 0 for a text without words."""
    norm = df.select(F.col(key).alias("key"), normalize_text(text).alias("norm"))
    named = norm.select("key", F.xxhash64("norm").alias("t1"), F.xxhash64(F.lit(1), "norm").alias("t2"), "norm")
    return run_sets(named, "norm", ["key", "t1", "t2"], size, blanks=True, name="shingles", wordless=True)


def evaluation_hits(rows: DataFrame, key: str, text: str, questions: DataFrame, threshold: float = 0.8, sets: DataFrame | None = None) -> DataFrame:
    """``key, hits``: ['exact'] where the normalised text is a question's, else the sorted ids of similar questions.

    ``questions`` has ``eval_id`` and ``question``; null and empty ones don't count. Rows without a hit are left
    out. Texts without words equal a question without words and are similar to none. ``sets``: the rows'
    :func:`shingle_sets`, where they are there already.
    """
    given = shingle_sets(rows, key, text) if sets is None else sets
    held = shingle_sets(questions.where("question is not null and question != ''"), "eval_id", "question")
    exact = given.join(held.select("t1", "t2").distinct(), ["t1", "t2"], "left_semi").select("key", F.array(F.lit("exact")).alias("hits"))
    exact = stage(exact, "exact-hits")
    given, held = given.where("n > 0"), held.where("n > 0")
    both = given.select(F.lit(False).alias("asked"), "c1", "c2", "n", "runs").unionByName(held.select(F.lit(True).alias("asked"), "c1", "c2", "n", "runs"))
    near = similar_classes(both, threshold, "not asked", "asked")
    ids = near.join(held.select(F.col("c1").alias("b1"), F.col("c2").alias("b2"), F.col("key").alias("eval_id")), ["b1", "b2"])
    by_class = ids.groupBy(F.col("a1").alias("c1"), F.col("a2").alias("c2")).agg(F.array_sort(F.collect_set("eval_id")).alias("hits"))
    hit = given.select("key", "c1", "c2").join(exact.select("key"), "key", "left_anti").join(by_class, ["c1", "c2"])
    return exact.unionByName(hit.select("key", "hits"))


def earlier_duplicates(rows: DataFrame, key: str, text: str, threshold: float = 0.8, sets: DataFrame | None = None) -> DataFrame:
    """``key, hits``: for each row the sorted keys of earlier rows (by key) that it repeats or nearly repeats.

    Of rows with one normalised text only the first is compared with later ones. A row that is itself a
    duplicate still counts as an earlier row, so this is a join and needs no recursion. Texts without words
    repeat nothing. The hits of a class of texts are gathered once and each row takes the earlier ones.
    ``sets``: the rows' :func:`shingle_sets`, where they are there already.
    """
    sets = (shingle_sets(rows, key, text) if sets is None else sets).where("n > 0")
    first = stage(sets.groupBy("t1", "t2", "c1", "c2").agg(F.min("key").alias("first")), "first-texts")
    near = similar_classes(sets, threshold).select("a1", "a2", "b1", "b2")
    own = first.select(F.col("c1").alias("a1"), F.col("c2").alias("a2")).distinct().select("a1", "a2", F.col("a1").alias("b1"), F.col("a2").alias("b2"))
    links = near.unionByName(near.toDF("b1", "b2", "a1", "a2")).unionByName(own)
    linked = links.join(first.select(F.col("c1").alias("b1"), F.col("c2").alias("b2"), "first"), ["b1", "b2"])
    by_class = linked.groupBy(F.col("a1").alias("c1"), F.col("a2").alias("c2")).agg(F.array_sort(F.collect_set("first")).alias("firsts"))
    hits = sets.select("key", "c1", "c2").join(by_class, ["c1", "c2"]).select("key", F.filter("firsts", lambda f: f < F.col("key")).alias("hits"))
    return hits.where("size(hits) > 0")


def row_similarity(a: str | Column, b: str | Column) -> Column:
    """Jaccard index of the shingles of two columns of one row. Both sets are made once, as one struct."""
    sets = F.array(F.struct(shingles(a).alias("a"), shingles(b).alias("b")))
    return F.transform(sets, lambda s: jaccard(s["a"], s["b"]))[0]
