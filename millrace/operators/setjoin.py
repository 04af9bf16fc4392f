"""Exact similarity joins of texts by their sets of word runs: prefix filter on rare runs, then verification.

Texts are compared by the Jaccard index of their sets of runs of consecutive words. Texts with equal sets form
one *class*, named by a 128-bit sum over its hashed runs (``c1``, ``c2``); all joins work on classes, so any
number of exact copies costs one row. Runs are compared by 64-bit hashes: the chance that a given pair's
overlap differs from the true one is below ``|A| * |B| / 2**64``.

No pair at or above the threshold is lost: runs are put in one global order, rarest first, and two sets
with similarity >= t must share one of the first ``n - ceil(t n) + 1`` runs of each. The order comes from
a sketch of frequencies counted over all texts; whatever its collisions, it is one fixed order, so it affects
speed only. What is shuffled is the prefixes, in rows of fixed width; whole sets travel only for the classes
of candidate pairs. A run that many classes have in their prefix is met in a grid of cells, so that no task
gets all of its postings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import stage
from .words import U, Words, chunks, mix, signed, unsigned

#: The sketch is counted in pieces of so many buckets, which is what its tasks send.
_PIECE = 1 << 14
#: Bits of the sketch at least and at most: what is broadcast is ``2**bits`` bytes.
LEAST_BITS, MOST_BITS = 16, 24
#: Postings of a run by cell; runs with more are split.
CELL = 8192


def run_sets(records: DataFrame, text: str, keep: list[str], run: int = 5, blanks: bool = False, name: str = "run-sets", wordless: bool = False) -> DataFrame:
    """A written table: ``keep`` and, of each text with any word, ``c1, c2`` (its class), ``n`` and ``runs``, ascending.

    Texts are cut into words once, here. Null, empty and wordless texts are left out; a text with fewer
    than ``run`` words has one run of all of them. ``blanks``: words are what stands between blanks. ``wordless``: texts
    without words are kept, with no runs; they are to be left out of joins.
    """
    schema = records.select(*keep).schema
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", c1 bigint, c2 bigint, n int, runs array<bigint>"

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, part in chunks(b.column(len(keep)).to_pylist()):
                of, h, _ = Words(part, blanks).runs(run)
                order = np.lexsort((h, of))
                of, h = of[order], h[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
                of, h = of[new], h[new]
                at = np.searchsorted(of, np.arange(len(part) + 1))
                some = np.arange(len(part)) if wordless else np.flatnonzero(np.diff(at))
                if not len(some):
                    continue
                ends = np.append(at[some], len(h))
                c1, c2 = (np.diff(np.concatenate((np.zeros(1, U), np.cumsum(x, dtype=U)))[ends]) for x in (mix(h), mix(h ^ U(0xA5A5A5A5A5A5A5A5))))
                cols = [b.column(i).slice(first, len(part)).take(pa.array(some)) for i in range(len(keep))]
                cols += [pa.array(signed(c1)), pa.array(signed(c2)), pa.array(np.diff(ends), pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(signed(h)))]
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, "c1", "c2", "n", "runs"])

    rows = records.where(F.col(text).isNotNull()).select(*keep, F.col(text))
    return stage(rows.mapInArrow(make, ddl), name)


def _values(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(all values, where each row's begin, with the end) of a column of lists."""
    at = np.asarray(lists.offsets)
    return unsigned(np.asarray(lists.values)[at[0] : at[-1]]), at - at[0]


def _once(b: pa.RecordBatch, columns: list[str]) -> pa.RecordBatch:
    """One row for each combination of the columns in a batch: copies in it count once."""
    keys = np.stack([np.asarray(b.column(c)).astype(np.int64) for c in columns], 1)
    return b.take(pa.array(np.sort(np.unique(keys, axis=0, return_index=True)[1]))) if len(keys) else b


def frequency_sketch(sets: DataFrame, bits: int | None = None) -> bytes:
    """One byte for each of ``2**bits`` buckets of runs: 8 log2 of one plus the sets with a run in it.

    Every set counts (copies within one Arrow batch once). ``bits`` grows with the number of runs, up to
    ``MOST_BITS``. Each of at most four tasks a core adds up its own array and sends it in pieces; these are
    added as they stream in, so memory depends on neither the number of tasks nor the input. The driver
    gets ``2**bits`` bytes.
    """
    spark = sets.sparkSession
    if bits is None:
        total = sets.agg(F.sum("n")).first()[0] or 0
        bits = min(MOST_BITS, max(LEAST_BITS, int(total).bit_length() - 3))
    size = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.uint32)
        for b in batches:
            bucket = (_values(_once(b, ["c1", "c2"]).column("runs"))[0] >> U(64 - bits)).view(np.int64)
            if len(bucket) > size >> 3:
                total += np.bincount(bucket, minlength=size).astype(np.uint32)
            else:
                at, n = np.unique(bucket, return_counts=True)
                total[at] += n.astype(np.uint32)
        pieces = [i for i in range(0, size, _PIECE) if total[i : i + _PIECE].any()]
        for lo in range(0, len(pieces), 64):
            part = pieces[lo : lo + 64]
            yield pa.RecordBatch.from_arrays([pa.array([i // _PIECE for i in part], pa.int32()), pa.array([total[i : i + _PIECE].tobytes() for i in part], pa.binary())], names=["piece", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}  # of the few pieces of this task
        for b in batches:
            for piece, counts in zip(b.column(0).to_pylist(), b.column(1)):
                part = np.frombuffer(counts.as_buffer(), np.uint32)
                if piece in sums:
                    sums[piece] += part
                else:
                    sums[piece] = part.astype(np.int64)
        for piece, total in sums.items():
            level = np.minimum(255, np.log2(total + 1) * 8).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([level.tobytes()], pa.binary())], names=["piece", "levels"])

    cores = spark.sparkContext.defaultParallelism
    counted = sets.select("c1", "c2", "runs").coalesce(4 * cores).mapInArrow(count, "piece int, counts binary")
    levels = counted.repartition(min(max(1, size // _PIECE), 2 * cores), "piece").mapInArrow(add, "piece int, levels binary")
    out = np.zeros(size, np.uint8)
    for row in levels.collect():  # 2**bits bytes in all
        part = np.frombuffer(row["levels"], np.uint8)
        out[row["piece"] * _PIECE :][: len(part)] = part
    return out.tobytes()


def prefix_length(n: np.ndarray, t: float) -> np.ndarray:
    return n - np.ceil(n * t - 1e-9).astype(np.int64) + 1


def prefixes(sets: DataFrame, sketch: bytes, t: float, cell: int = CELL) -> DataFrame:
    """``run, cell, pos, n, c1, c2`` for each of the rarest runs of each class that the prefix filter needs, distinct.

    A run that the sketch puts into more than ``cell`` sets has p groups of classes and a cell for each
    pair of groups; a class's posting goes to the p cells of its group, and any two classes meet in
    one. Both sides of a join use the same cells, as both know the sketch. Copies of a class are removed by
    batch before the shuffle and by (run, cell) after it, so the rows of a hot class don't meet.
    """
    shared = sets.sparkSession.sparkContext.broadcast(sketch)  # 2**MOST_BITS bytes at most

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.frombuffer(shared.value, np.uint8)
        shift = U(64 - (len(level).bit_length() - 1))
        for b in batches:
            b = _once(b, ["c1", "c2"])
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                h, at = _values(part.column("runs"))
                sizes = np.diff(at)
                of = np.repeat(np.arange(len(sizes)), sizes)
                rarity = level[(h >> shift).view(np.int64)]
                order = np.lexsort((h, rarity, of))
                pos = np.arange(len(h)) - np.repeat(at[:-1], sizes)
                first = np.flatnonzero(pos < np.repeat(prefix_length(sizes, t), sizes))
                own, run, place = of[first], h[order][first], pos[first]
                groups = np.maximum(1, np.ceil(np.exp2(rarity[order][first] / 8) / cell)).astype(np.int64)
                c1, c2 = (np.asarray(part.column(c)) for c in ("c1", "c2"))
                group = (mix(unsigned(c1[own])) % groups.astype(U)).astype(np.int64)
                again = np.repeat(np.arange(len(own)), groups)
                other = np.arange(len(again)) - np.repeat(np.cumsum(groups) - groups, groups)
                low, high = np.minimum(group[again], other), np.maximum(group[again], other)
                own = own[again]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(run[again])), pa.array(low * groups[again] + high), pa.array(place[again], pa.int32()), pa.array(sizes[own], pa.int32()), pa.array(c1[own]), pa.array(c2[own])],
                    names=["run", "cell", "pos", "n", "c1", "c2"],
                )

    each = sets.select("c1", "c2", "runs").mapInArrow(make, "run bigint, cell bigint, pos int, n int, c1 bigint, c2 bigint")
    return each.repartition("run", "cell").dropDuplicates()


def may_match(t: float) -> Column:
    """Length and position filter: the shared run still allows the overlap that ``t`` needs."""
    n_a, n_b = F.col("n_a"), F.col("n_b")
    need = F.ceil((n_a + n_b) * F.lit(t / (1 + t)) - F.lit(1e-9))
    return (F.least(n_a, n_b) >= F.greatest(n_a, n_b) * F.lit(t) - F.lit(1e-9)) & (F.least(n_a - F.col("pos_a"), n_b - F.col("pos_b")) >= need)


def candidate_pairs(sets: DataFrame, t: float, a: str | None = None, b: str | None = None, bits: int | None = None, cell: int = CELL) -> DataFrame:
    """A written table of the distinct pairs ``a1, a2, b1, b2`` of different classes that the prefix, length and position filters leave.

    ``a`` and ``b`` are conditions on ``sets`` for the two sides; without them all classes are
    compared with each other, the lesser first.
    """
    sketch = frequency_sketch(sets, bits)
    left = prefixes(sets if a is None else sets.where(a), sketch, t, cell)
    right = left if b is None else prefixes(sets.where(b), sketch, t, cell)
    x = left.select("run", "cell", F.col("pos").alias("pos_a"), F.col("n").alias("n_a"), F.col("c1").alias("a1"), F.col("c2").alias("a2"))
    y = right.select("run", "cell", F.col("pos").alias("pos_b"), F.col("n").alias("n_b"), F.col("c1").alias("b1"), F.col("c2").alias("b2"))
    apart = "(a1 < b1 or (a1 = b1 and a2 < b2))" if b is None else "(a1 != b1 or a2 != b2)"
    return stage(x.join(y, ["run", "cell"]).where(may_match(t) & F.expr(apart)).select("a1", "a2", "b1", "b2").distinct(), "candidates")


def classes_of(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """A written table ``c1, c2, n, runs`` of the classes that occur in ``pairs``, once each."""
    named = pairs.select(F.col("a1").alias("c1"), F.col("a2").alias("c2")).unionByName(pairs.select(F.col("b1").alias("c1"), F.col("b2").alias("c2")))
    needed = sets.select("c1", "c2", "n", "runs").join(stage(named.distinct(), "candidate-classes"), ["c1", "c2"], "left_semi")
    return stage(needed.groupBy("c1", "c2").agg(F.first("n").alias("n"), F.first("runs").alias("runs")), "candidate-sets")


def verified(pairs: DataFrame, classes: DataFrame, t: float) -> DataFrame:
    """Of pairs ``a1, a2, b1, b2`` of classes those with similarity >= t, with ``similarity``, from the whole sets."""
    a = classes.select(F.col("c1").alias("a1"), F.col("c2").alias("a2"), F.col("n").alias("n_a"), F.col("runs").alias("runs_a"))
    b = classes.select(F.col("c1").alias("b1"), F.col("c2").alias("b2"), F.col("n").alias("n_b"), F.col("runs").alias("runs_b"))
    common = F.size(F.array_intersect("runs_a", "runs_b"))
    scored = pairs.join(a, ["a1", "a2"]).join(b, ["b1", "b2"]).select("a1", "a2", "b1", "b2", "n_a", "n_b", common.alias("common"))
    index = F.col("common") / (F.col("n_a") + F.col("n_b") - F.col("common"))
    return scored.select("a1", "a2", "b1", "b2", index.alias("similarity")).where(F.col("similarity") >= F.lit(t))


def similar_classes(sets: DataFrame, t: float, a: str | None = None, b: str | None = None, bits: int | None = None, cell: int = CELL) -> DataFrame:
    """``a1, a2, b1, b2, similarity`` of the pairs of different classes of :func:`run_sets` with a Jaccard index >= ``t``.

    With sides, a class that is on both is also paired with itself.
    """
    found = candidate_pairs(sets, t, a, b, bits, cell)
    out = verified(found, classes_of(found, sets), t)
    if b is None:
        return out
    both = sets.groupBy("c1", "c2").agg(F.max(F.expr(a)).alias("a"), F.max(F.expr(b)).alias("b")).where("a and b")
    return out.unionByName(both.select(F.col("c1").alias("a1"), F.col("c2").alias("a2"), F.col("c1").alias("b1"), F.col("c2").alias("b2"), F.lit(1.0).alias("similarity")))
