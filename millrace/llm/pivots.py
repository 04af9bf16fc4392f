"""Problem 3: near-duplicate records with small edits, by pivot distance tables over fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.setjoin import CELL, candidate_pairs, classes_of, run_sets, verified
from ..operators.staging import stage
from ..operators.words import U, unsigned
from .components import connected_components

#: A fingerprint has one bit for each of so many ranges of run hashes; the base pivots cut it into equal regions.
FINGERPRINT_BITS, BASE_PIVOTS = 4096, 64
_REGION = FINGERPRINT_BITS // BASE_PIVOTS


def pivot_table(classes: DataFrame) -> DataFrame:
    """A written table ``c1, c2, n, pivots``: the fingerprint's Hamming distances to the base pivots, a byte each.

    Bit i of a fingerprint is set if a run hashes into range i. Base pivot k has the bits of region k
    set and no others, so the distance to it is ``bits + region size - 2 (bits in the region)``; what is
    stored is the number of bits in each region, from which every distance follows.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs = b.column(3)
            at = np.asarray(runs.offsets)
            h = unsigned(np.asarray(runs.values)[at[0] : at[-1]])
            of = np.repeat(np.arange(len(at) - 1, dtype=np.int64), np.diff(at))
            bit = np.unique(of * FINGERPRINT_BITS + (h >> U(64 - FINGERPRINT_BITS.bit_length() + 1)).view(np.int64))
            table = np.bincount(bit // _REGION, minlength=(len(at) - 1) * BASE_PIVOTS).astype(np.uint8).reshape(-1, BASE_PIVOTS)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), pa.array([row.tobytes() for row in table], pa.binary())], names=["c1", "c2", "n", "pivots"])

    return stage(classes.select("c1", "c2", "n", "runs").mapInArrow(make, "c1 bigint, c2 bigint, n int, pivots binary"), "pivot-table")


def within_pivot_distance(candidates: DataFrame, table: DataFrame, t: float) -> DataFrame:
    """Candidates whose pivot distances differ by no more than those of two sets with similarity >= t can.

    The reference fingerprints are all ``2**64`` unions of base pivots. The distances of two
    fingerprints to a pivot differ by at most their own Hamming distance, and this is at most the
    size of the sets' symmetric difference, ``(n_a + n_b) (1 - t) / (1 + t)`` at similarity t. The
    largest difference over all unions is the sum of the regions' differences (the union of the regions
    where one side has more, or its complement, attains it), so it is had from the base table alone.
    """

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = []
            for i in range(0, b.num_rows, 1 << 14):
                s = b.slice(i, 1 << 14)
                x, y = (np.frombuffer(b"".join(s.column(k).to_pylist()), np.uint8).reshape(-1, BASE_PIVOTS).astype(np.int16) for k in ("pivots_a", "pivots_b"))
                n = np.asarray(s.column("n_a")) + np.asarray(s.column("n_b"))
                kept.append(np.abs(x - y).sum(1) <= n * ((1 - t) / (1 + t)) + 1e-9)
            rows = b.filter(pa.array(np.concatenate(kept) if kept else np.zeros(0, bool)))
            yield pa.RecordBatch.from_arrays([rows.column(c) for c in ("a1", "a2", "b1", "b2")], names=["a1", "a2", "b1", "b2"])

    a, b = (table.select(*(F.col(c).alias(to) for c, to in zip(("c1", "c2", "n", "pivots"), (f"{s}1", f"{s}2", f"n_{s}", f"pivots_{s}")))) for s in "ab")
    both = candidates.join(a, ["a1", "a2"]).join(b, ["b1", "b2"]).select("a1", "a2", "b1", "b2", "n_a", "n_b", "pivots_a", "pivots_b")
    return both.mapInArrow(keep, "a1 bigint, a2 bigint, b1 bigint, b2 bigint")


@dataclass
class NearDuplicates:
    """What each step of :func:`near_duplicates` left, as written tables, and the classes' members."""

    candidates: DataFrame
    survivors: DataFrame
    pairs: DataFrame
    members: DataFrame

    def pruning(self) -> DataFrame:
        """One row: candidate pairs of classes, those the pivot tables discarded, and those that are similar."""
        one = lambda df, name: df.agg(F.count("*").alias(name))
        return one(self.candidates, "candidates").crossJoin(one(self.survivors, "survivors")).crossJoin(one(self.pairs, "similar")).select("candidates", (F.col("candidates") - F.col("survivors")).alias("discarded"), "similar")


def near_duplicates(records: DataFrame, threshold: float = 0.8, run: int = 5, sketch_bits: int | None = None, cell: int = CELL) -> NearDuplicates:
    """Pairs of classes with similarity of at least ``threshold``, and the classes' members.

    ``records`` has ``key`` and ``text``; other columns are ignored. Fingerprints of unrelated texts
    lie about equally far from any pivot, so pivots alone cannot say which pairs to look at: an index
    of each class's rarest runs names the candidates (it loses no pair at the threshold), their pivot
    tables discard nearly all that are not similar, and only the survivors' sets are read and compared exactly.

    ``pairs``: ``a1, a2, b1, b2, similarity``, one row per pair of different classes. ``members``:
    ``key, c1, c2``, distinct. Texts with equal sets of runs are one class, so copies are never
    paired with each other here. Null keys and null, empty and wordless texts are left out;
    shorter texts than ``run`` words count as one run. Empty input gives empty results.
    """
    records = records.select("key", "text").where("key is not null")
    sets = run_sets(records, "text", ["key"], run, name="near-sets")
    candidates = candidate_pairs(sets, threshold, bits=sketch_bits, cell=cell)
    classes = classes_of(candidates, sets)
    survivors = stage(within_pivot_distance(candidates, pivot_table(classes), threshold), "near-survivors")
    pairs = stage(verified(survivors, classes, threshold), "near-pairs")
    return NearDuplicates(candidates, survivors, pairs, sets.select("key", "c1", "c2").distinct())


def record_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """``a < b``: all pairs of records of linked classes, and of records of the same class."""
    one = members.select(F.col("c1").alias("a1"), F.col("c2").alias("a2"), F.col("key").alias("x"))
    two = members.select(F.col("c1").alias("b1"), F.col("c2").alias("b2"), F.col("key").alias("y"))
    across = pairs.join(one, ["a1", "a2"]).join(two, ["b1", "b2"]).where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    inside = one.join(two, (F.col("a1") == F.col("b1")) & (F.col("a2") == F.col("b2"))).where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return across.unionByName(inside).distinct()


def groups(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """One row per record: ``key``, ``group_id`` (the smallest key of all records joined by links), ``copies`` and ``links``.

    ``copies``: records of the same class, itself included; ``links``: other classes similar to its own. A
    class with a large part of all records is one row until its members are given their group, by a join in
    which each member of a class that has more than one goes to one of the class's 16 salts.
    """
    members = stage(members, "near-members")
    classes = stage(members.groupBy("c1", "c2").agg(F.min("key").alias("rep"), F.count("*").alias("copies")), "near-reps")
    rep = classes.select("c1", "c2", "rep")
    edges = pairs.join(rep.toDF("a1", "a2", "a"), ["a1", "a2"]).join(rep.toDF("b1", "b2", "b"), ["b1", "b2"]).select("a", "b")
    edges = stage(edges, "near-edges")
    degree = edges.select("a").unionByName(edges.select(F.col("b").alias("a"))).groupBy(F.col("a").alias("rep")).agg(F.count("*").alias("links"))
    found = classes.join(degree, "rep", "left").join(connected_components(edges).withColumnRenamed("id", "rep"), "rep", "left")
    found = stage(found.select("c1", "c2", "rep", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "rep").alias("group_id")), "near-groups")
    single = found.where("copies = 1").select(F.col("rep").alias("key"), "group_id", "copies", "links")
    salts = F.explode(F.sequence(F.lit(0), F.lit(15)))
    salted = found.where("copies > 1").select("c1", "c2", "group_id", "copies", "links", salts.alias("salt"))
    own = members.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(16)).cast("int"))
    return own.join(salted, ["c1", "c2", "salt"]).select("key", "group_id", "copies", "links").unionByName(single)
