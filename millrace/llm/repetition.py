"""Problem 6: repetition inside one document, by an isolation forest on rule statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.words import U, Words, chunks, mix

FEATURES = ["run_share", "sentence_share", "line_share", "word_share", "top_share"]
_SENTENCE = np.array([ord(c) for c in ".!?。！？\n"], np.uint32)


def _repeated_share(text: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``n`` texts the weight of the items that occur more than once over all weight, and the largest item's."""
    order = np.lexsort((h, text))
    text, h, weight = text[order], h[order], weight[order]
    total = np.bincount(text, weight, n)
    if not len(h):
        return np.zeros(n), np.zeros(n)
    begin = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (text[1:] != text[:-1]))))
    size = np.diff(np.append(begin, len(h)))
    mass = np.add.reduceat(weight, begin)
    repeated = np.bincount(text[begin], mass * (size > 1), n)
    top = np.zeros(n)
    np.maximum.at(top, text[begin], mass * (size > 1))
    safe = np.maximum(total, 1)
    return repeated / safe, top / safe


def _segments(w: Words, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, words) of the pieces between marks at the code points ``ends``; pieces without words are left out."""
    if not len(w.hash):
        z = np.zeros(0, np.int64)
        return z, z.view(U), z
    piece = np.searchsorted(ends, w.start)
    text = np.searchsorted(w.text_at, w.start, "right") - 1
    begin = np.flatnonzero(np.concatenate(([True], (piece[1:] != piece[:-1]) | (text[1:] != text[:-1]))))
    size = np.diff(np.append(begin, len(piece)))
    within = np.arange(len(piece)) - np.repeat(begin, size)
    return text[begin], np.add.reduceat(mix(w.hash + mix(within.astype(U))), begin), size


def statistics(texts: list[str], run: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(number of words, one row of FEATURES) of each text.

    run_share: share of the word runs, by position, that occur more than once. sentence_share and
    line_share: share of the words in sentences and lines that occur more than once. word_share:
    share of words that repeat an earlier one. top_share: share of the most frequent repeated run.
    """
    w, n = Words(texts), len(texts)
    counts = w.counts()
    text, h, _ = w.runs(run, short=False)
    run_share, top = _repeated_share(text, h, np.ones(len(h)), n)
    marks = np.flatnonzero(np.isin(w.cps, _SENTENCE))
    sentence, _ = _repeated_share(*_segments(w, marks), n)
    line, _ = _repeated_share(*_segments(w, np.flatnonzero(w.cps == 10)), n)
    of = np.repeat(np.arange(n), counts)
    order = np.lexsort((w.hash, of))
    o, x = of[order], w.hash[order]
    fresh = np.ones(len(o), bool)
    fresh[1:] = (o[1:] != o[:-1]) | (x[1:] != x[:-1])
    words = 1 - np.bincount(o, fresh, n) / np.maximum(counts, 1)
    return counts, np.column_stack((run_share, sentence, line, np.where(counts > 0, words, 0), top))


def _unsplit(n: np.ndarray | float) -> np.ndarray:
    """Mean depth at which ``n`` points left together would be told apart."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1), n == 2)


@dataclass
class Forest:
    """Trees as arrays: the feature of each node (-1: leaf), its split and left child (the right one follows), its depth if a leaf."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def fit(cls, rows: np.ndarray, trees: int, sample: int, seed: int) -> Forest:
        rng = np.random.default_rng(seed)
        out = []
        for _ in range(trees if len(rows) else 0):
            x = rows[rng.permutation(len(rows))[:sample]]
            deepest = int(np.ceil(np.log2(max(2, len(x)))))
            feature, split, left, depth = [-1], [0.0], [0], [0.0]
            todo = [(0, np.arange(len(x)), 0)]
            while todo:
                at, own, d = todo.pop()
                low, high = x[own].min(0), x[own].max(0)
                varied = np.flatnonzero(high > low)
                if d >= deepest or len(own) < 2 or not len(varied):
                    depth[at] = d + float(_unsplit(len(own)))
                    continue
                f = int(rng.choice(varied))
                s = float(rng.uniform(low[f], high[f]))
                feature[at], split[at], left[at] = f, s, len(feature)
                for side in (x[own, f] < s, x[own, f] >= s):
                    todo.append((len(feature), own[side], d + 1))
                    feature.append(-1), split.append(0.0), left.append(0), depth.append(0.0)
            out.append((np.array(feature), np.array(split), np.array(left), np.array(depth)))
        return cls(out)

    def path(self, rows: np.ndarray) -> np.ndarray:
        """Mean path length of each row; short paths are anomalies."""
        total = np.zeros(len(rows))
        for feature, split, left, depth in self.trees:
            at = np.zeros(len(rows), np.int64)
            while (open_ := feature[at] >= 0).any():
                i = np.flatnonzero(open_)
                node = at[i]
                at[i] = left[node] + (rows[i, feature[node]] >= split[node])
            total += depth[at]
        return total / max(1, len(self.trees))

    def longest(self, least: np.ndarray) -> float:
        """The longest mean path that a row can have whose features are at least ``least``."""
        total = 0.0
        for feature, split, left, depth in self.trees:
            most, todo = 0.0, [0]
            while todo:
                at = todo.pop()
                if feature[at] < 0:
                    most = max(most, depth[at])
                else:
                    todo.append(left[at] + 1)
                    if least[feature[at]] < split[at]:
                        todo.append(left[at])
            total += most
        return total / max(1, len(self.trees))


def fit_forest(texts: DataFrame, share: float, least_words: int, run: int, trees: int, subsample: int, labelled_rows: int, seed: int) -> tuple[Forest, float, float]:
    """(forest, calibrated path, certain path), fitted on the ``labelled_rows`` rows with the smallest keyed hash.

    The sample's bound is a parameter; it does not grow with the input, and only its statistics leave the executors. A row's label is whether
    its share of repeated runs reaches ``share``. The calibrated path is the longest path of a row so
    labelled; the certain path is the longest that any row with that share can have in these trees,
    so a row above it cannot reach the share.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, part in chunks(b.column(0).to_pylist()):
                counts, x = statistics(part, run)
                yield pa.RecordBatch.from_arrays([pa.array(counts.astype(np.int32)), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))], names=["words", "x"])

    texts = texts.where("text is not null")
    rank = F.xxhash64(F.lit(seed), "key", "field_name")
    total = texts.count()
    share_read = 2 * labelled_rows / total if total > 4 * labelled_rows else 1
    while True:
        # about twice the bound is left, repeated rows once; then the lowest are taken
        low = texts.where(rank < F.lit(int(share_read * 2**64) - 2**63)) if share_read < 1 else texts
        lowest = low.select(rank.alias("rank"), "text").distinct().orderBy("rank", "text").limit(labelled_rows)
        rows = lowest.select("text").mapInArrow(measure, "words int, x array<double>").collect()  # numbers only, of the stated bound
        if share_read >= 1 or len(rows) >= labelled_rows:
            break
        share_read *= 8  # rows repeat, so that fewer than the bound are under the cut
    counts = np.array([r["words"] for r in rows])
    x = np.array([r["x"] for r in rows], float).reshape(-1, len(FEATURES))
    forest = Forest.fit(x, trees, subsample, seed)
    path = forest.path(x)
    labelled = (counts >= least_words) & (x[:, 0] >= share)
    certain = forest.longest(np.array([share, *[0.0] * (len(FEATURES) - 1)]))
    return forest, float(path[labelled].max()) if labelled.any() else certain, certain


def repeated_content(
    texts: DataFrame, share: float = 0.4, least_words: int = 20, run: int = 5, trees: int = 100, subsample: int = 256, labelled_rows: int = 4096, seed: int = 7
) -> DataFrame:
    """``key, field_name, words``, the statistics, ``path``, ``anomalous`` and ``possible`` of each text.

    ``texts`` has ``key``, ``field_name`` and ``text``; other columns are ignored. ``path`` is the mean
    path length in an isolation forest on the statistics. ``anomalous``: the path is no longer than
    the longest of the labelled rows. ``possible``: the path does not rule out a repeated share of
    ``share`` (see :func:`fit_forest`); every text that has it is ``possible``, so an exact check may
    look at these only. Texts with fewer than ``least_words`` words are neither.

    Null texts are left out; empty and wordless ones have statistics of 0. Rows that occur again give
    equal rows. An empty table gives an empty result. The statistics cover whole texts.
    """
    texts = texts.select(F.col("key").cast("string").alias("key"), "field_name", "text")
    forest, calibrated, certain = fit_forest(texts, share, least_words, run, trees, subsample, labelled_rows, seed)
    model = texts.sparkSession.sparkContext.broadcast(forest)  # bounded by trees and subsample
    names = ["key", "field_name", "words", *FEATURES, "path", "anomalous", "possible"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, part in chunks(b.column(2).to_pylist()):
                counts, x = statistics(part, run)
                path = model.value.path(x)
                long_enough = counts >= least_words
                cols = [b.column(0).slice(first, len(part)), b.column(1).slice(first, len(part)), pa.array(counts.astype(np.int32))]
                cols += [pa.array(np.ascontiguousarray(x[:, i])) for i in range(len(FEATURES))]
                cols += [pa.array(path), pa.array((path <= calibrated) & long_enough), pa.array((path <= certain) & long_enough)]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    ddl = "key string, field_name string, words int, " + ", ".join(f"{f} double" for f in FEATURES) + ", path double, anomalous boolean, possible boolean"
    return texts.where("text is not null").mapInArrow(score, ddl)


def calibration(scored: DataFrame, share: float = 0.4, least_words: int = 20) -> DataFrame:
    """One row: how ``anomalous`` and ``possible`` of :func:`repeated_content` compare with the rule, over all texts.

    ``texts`` of at least ``least_words`` words, those with a repeated share of ``share`` (``repeated``), those the
    forest calls anomalous and possible, and the recall and precision of ``anomalous``; null where nothing is divided by.
    """
    rule = (F.col("words") >= least_words) & (F.col("run_share") >= share)
    counts = scored.distinct().agg(
        F.count_if(F.col("words") >= least_words).alias("texts"), F.count_if(rule).alias("repeated"), F.count_if("anomalous").alias("anomalous"), F.count_if(rule & F.col("anomalous")).alias("both"),
        F.count_if("possible").alias("possible"), F.count_if(rule & ~F.col("possible")).alias("lost"),
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return counts.select("texts", "repeated", "anomalous", "possible", "lost", ratio("both", "repeated").alias("recall"), ratio("both", "anomalous").alias("precision"))
