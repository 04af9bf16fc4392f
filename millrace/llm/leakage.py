"""Problem 7: evaluation texts inside training texts, by word-run seeds and Smith-Waterman alignment."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.words import U, Words, chunks, signed

_BITS = 20


@dataclass
class Items:
    """Evaluation items of one block: their word hashes and the seeds that lead to them."""

    ids: list[str]
    words: list[np.ndarray]
    seed_hash: np.ndarray = field(default_factory=lambda: np.zeros(0, U))  # sorted, one per place
    seed_item: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    seed_pos: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    seed_size: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))


def _runs(w: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words, as :meth:`Words.runs` has them for full runs."""
    x = Words.__new__(Words)
    x.hash, x.at = w, np.array([0, len(w)])
    return x.runs(n, short=False)[1]


def _sieve(hashes: np.ndarray) -> np.ndarray:
    table = np.zeros(1 << _BITS, bool)
    table[(hashes >> U(64 - _BITS)).view(np.int64)] = True
    return table


def _hits(w: Words, n: int, seeds: np.ndarray, sieve: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, place in the distinct sorted ``seeds``) of each run of ``n`` words that is a seed."""
    text, h, pos = w.runs(n, short=False)
    near = np.flatnonzero(sieve[(h >> U(64 - _BITS)).view(np.int64)])
    at = np.searchsorted(seeds, h[near])
    ok = at < len(seeds)
    ok[ok] = seeds[at[ok]] == h[near[ok]]
    return text[near[ok]], pos[near[ok]], at[ok]


def all_seeds(items: Items, size: int) -> Items:
    """Every run of ``size`` words of every item, or all of a shorter item's: a choice among them would lose edited copies."""
    sizes = [min(size, len(w)) for w in items.words]
    hashes = [_runs(w, n) for w, n in zip(items.words, sizes)]
    h = np.concatenate([np.zeros(0, U), *hashes])
    item = np.repeat(np.arange(len(hashes)), [len(x) for x in hashes]) if hashes else np.zeros(0, np.int64)
    pos = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(x)) for x in hashes)])
    order = np.argsort(h, kind="stable")
    return Items(items.ids, items.words, h[order], item[order].astype(np.int32), pos[order].astype(np.int32), np.array(sizes, np.int32)[item[order]])


def longest_runs(text: np.ndarray, item: np.ndarray, diagonal: np.ndarray, pos: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, item, words of the longest equal run) of each pair, from all its places with ``n`` equal words."""
    order = np.lexsort((pos, diagonal, item, text))
    text, item, diagonal, pos = text[order], item[order], diagonal[order], pos[order]
    pair = np.ones(len(text), bool)
    pair[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1])
    stretch = pair.copy()
    stretch[1:] |= (diagonal[1:] != diagonal[:-1]) | (pos[1:] != pos[:-1] + 1)
    first = np.flatnonzero(stretch)
    of = np.flatnonzero(pair[first])
    runs = np.maximum.reduceat(np.diff(first, append=len(text)), of) + n - 1 if len(of) else of
    return text[first[of]], item[first[of]], runs


def smith_waterman(a: np.ndarray, b: np.ndarray, match: int = 2, miss: int = -1, gap: int = -1) -> int:
    """Best score of a local alignment of two word sequences, row by row."""
    best, last = 0, np.zeros(len(b) + 1, np.int64)
    ramp = np.arange(len(b) + 1) * gap
    for x in a:
        row = np.zeros(len(b) + 1, np.int64)
        row[1:] = np.maximum(last[:-1] + np.where(b == x, match, miss), last[1:] + gap)
        row = np.maximum(row, 0)
        row = np.maximum.accumulate(row - ramp) + ramp  # gaps along the row
        best, last = max(best, int(row.max())), row
    return best


def words_met(w: Words, text: np.ndarray, item: np.ndarray, flat: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each pair of a text and an item, ordered by text, how many of the item's words the text has, all items of a text at once.

    An alignment's score is at most twice that, so it tells which of the many items that share a common run need no alignment.
    """
    out = np.zeros(len(text), np.int64)
    head = np.flatnonzero(np.concatenate((np.ones(min(1, len(text)), bool), text[1:] != text[:-1])))
    for lo, hi in zip(head, np.append(head[1:], len(text))):
        doc = np.unique(w.hash[w.at[text[lo]] : w.at[text[lo] + 1]])
        own = item[lo:hi]
        n = sizes[own]
        at = np.repeat(begin[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        found = np.searchsorted(doc, flat[at])
        met = doc[np.minimum(found, len(doc) - 1)] == flat[at]
        out[lo:hi] = np.add.reduceat(met, np.cumsum(n) - n, dtype=np.int64)
    return out


def best_alignment(doc: np.ndarray, q: np.ndarray, least: float = 0) -> int:
    """Best score of a local alignment of an item with a whole document, or 0 if it is certainly below ``least``.

    Each word of the item adds 2 at most, and only if the document has it. A stretch of ``2 * len(q)``
    words that the item lacks costs all that the other side can add, so the sides are aligned apart.
    """
    if 2 * np.count_nonzero(np.isin(q, doc)) < least:
        return 0
    met = np.flatnonzero(np.isin(doc, q))
    if not len(met):
        return 0
    cuts = np.flatnonzero(np.diff(met) > 2 * len(q))
    return max(smith_waterman(q, doc[lo : hi + 1]) for lo, hi in zip(met[np.concatenate(([0], cuts + 1))], met[np.concatenate((cuts, [-1]))]))


def leaked_items(
    documents: DataFrame, items: DataFrame, seed_words: int = 5, window: int = 12, least_score: float = 0.5, block_items: int = 20_000, block_chars: int = 8_000_000
) -> DataFrame:
    """``doc_id, eval_id, run, words, score``: documents with passages of evaluation items.

    ``documents`` has ``doc_id`` and ``text``, ``items`` has ``eval_id`` and ``question``; other
    columns are ignored. Seeds are all runs of ``seed_words`` words of the items (all words of a
    shorter item). ``run`` is the longest equal run of a document and an item that share a seed, and
    the document is aligned with the item (Smith-Waterman: 2 for equal words, -1 for others and
    gaps). ``score`` is the best alignment over twice the item's ``words``: 1 is a whole copy, less
    an edited or partial one. Rows are all pairs with ``run`` of at least ``min(window, words)``, and
    all that share a seed with ``score >= least_score``.

    The items are taken in blocks of about ``block_items`` of ``block_chars`` characters together, whatever their
    number (what is broadcast is a block's word hashes, some 5 bytes a character), and each block reads the
    documents once. Items or documents with a null id, or that are
    null, empty or without words, match nothing; equal questions under two ids each count; repeated
    rows count once. Empty tables give an empty result.
    """
    items = items.select(F.col("eval_id").cast("string").alias("eval_id"), "question").where("eval_id is not null and question is not null")
    n, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("question")), F.lit(0))).first()
    n_blocks = max(1, -(-n // block_items), -(-chars // block_chars))
    out = None
    for k in range(n_blocks):
        part = items if n_blocks == 1 else items.where(F.pmod(F.xxhash64("eval_id", "question"), F.lit(n_blocks)) == k)
        found = _block(documents, part, seed_words, window, least_score)
        out = found if out is None else out.unionByName(found)
    return out.groupBy("doc_id", "eval_id").agg(F.max("run").alias("run"), F.max("words").alias("words"), F.max("score").alias("score"))


def _block(documents: DataFrame, part: DataFrame, seed_words: int, window: int, least_score: float) -> DataFrame:
    rows = sorted({(r["eval_id"], r["question"]) for r in part.collect()})  # one block of the stated items
    items = Items([], [])
    for first, texts in chunks([q for _, q in rows]):
        w = Words(texts)
        for j in range(len(texts)):
            if w.at[j + 1] > w.at[j]:
                items.ids.append(rows[first + j][0])
                items.words.append(w.hash[w.at[j] : w.at[j + 1]])
    documents = documents.select("doc_id", "text").where("doc_id is not null and text is not null")
    items = all_seeds(items, seed_words)
    shared = documents.sparkSession.sparkContext.broadcast(items)  # bounded by block_items

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it = shared.value
        by_size = {}
        sizes = np.array([len(q) for q in it.words], np.int64)
        flat, begin = np.concatenate([np.zeros(0, U), *it.words]), np.cumsum(sizes) - sizes
        for n in np.unique(it.seed_size):
            own = np.flatnonzero(it.seed_size == n)
            h = np.unique(it.seed_hash[own])
            by_size[int(n)] = (own, h, _sieve(h), np.searchsorted(it.seed_hash[own], h), np.searchsorted(it.seed_hash[own], h, "right"))
        for b in batches:
            for first, texts in chunks(b.column(1).to_pylist()):
                w = Words(texts)
                found = []
                for n, (own, h, sieve, low, high) in by_size.items():
                    text, pos, at = _hits(w, n, h, sieve)
                    count = high[at] - low[at]
                    hit = np.repeat(np.arange(len(at)), count)
                    s = own[low[at][hit] + np.arange(len(hit)) - (np.cumsum(count) - count)[hit]]
                    place = pos[hit] - w.at[text[hit]]
                    pairs = longest_runs(text[hit], it.seed_item[s], place - it.seed_pos[s], place, n)
                    copies = pairs[2] >= np.minimum(window, sizes[pairs[1]])
                    may = copies | (words_met(w, pairs[0], pairs[1], flat, begin, sizes) >= least_score * sizes[pairs[1]] - 1e-9)
                    for t, item, run, copied in zip(*(x[may].tolist() for x in (*pairs, copies))):
                        doc, q = w.hash[w.at[t] : w.at[t + 1]], it.words[item]
                        best = 2 * len(q) if run == len(q) else best_alignment(doc, q, 0 if copied else 2 * least_score * len(q))
                        score = best / (2 * len(q))
                        if copied or score >= least_score:
                            found.append((first + t, item, run, len(q), score))
                ids = b.column(0).take(pa.array([f[0] for f in found], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([it.ids[f[1]] for f in found], pa.string()), pa.array([f[2] for f in found], pa.int32()), pa.array([f[3] for f in found], pa.int32()), pa.array([f[4] for f in found], pa.float64())],
                    names=["doc_id", "eval_id", "run", "words", "score"],
                )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.mapInArrow(align, f"doc_id {kind}, eval_id string, run int, words int, score double")
