"""Problem 9: long exact spans shared between records, by super-k-mer partitioning.

A window is ``span`` consecutive characters. Its minimiser is the least hash of the ``seed``-character
pieces in it, so equal windows have equal minimisers; consecutive windows with one minimiser travel as
one string, the super-k-mer, to the bucket of that minimiser, where the windows are sorted and counted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import join_counted
from ..operators.staging import stage
from ..operators.words import U, chunks, code_points, mix, powers, prefix_hashes, signed

_EMPTY = np.zeros(0, np.int64)
_COLLISION = "two different windows have one 128-bit hash"


def _window_hashes(cps: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    p, (_, down) = prefix_hashes(cps, salt), powers(len(cps) + 1)
    m = max(0, len(cps) - size + 1)
    return mix((p[size : size + m] - p[:m]) * down[:m])


def _sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each ``w`` consecutive values: of a block's end and the next block's beginning."""
    m = len(x) - w + 1
    if m <= 0:
        return x[:0]
    full = np.full(-(-len(x) // w) * w, np.iinfo(U).max, U)
    full[: len(x)] = x
    blocks = full.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:m], ahead[w - 1 : w - 1 + m])


def super_kmers(texts: list[str], span: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, minimiser, first window, windows) of each super-k-mer, windows numbered within their text."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.concatenate(([0], np.cumsum(sizes)))
    cps = code_points(texts)
    least = _sliding_least(_window_hashes(cps, seed), span - seed + 1)
    per = np.maximum(0, sizes - span + 1)
    if not per.sum():
        return _EMPTY, _EMPTY.view(U), _EMPTY, _EMPTY
    of = np.repeat(np.arange(len(texts)), per)
    start = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    value = least[begin[of] + start]
    first = np.flatnonzero(np.concatenate(([True], (value[1:] != value[:-1]) | (of[1:] != of[:-1]))))
    return of[first], value[first], start[first], np.diff(np.append(first, len(value)))


def _marked(h1: np.ndarray, h2: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Order of the windows by hash, and for each (in order) whether its run of equal hashes has two owners."""
    order = np.lexsort((h2, h1))
    a, b, o = h1[order], h2[order], owner[order]
    head = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
    mixed = np.minimum.reduceat(o, head) != np.maximum.reduceat(o, head)
    return order, np.repeat(mixed, np.diff(np.append(head, len(o)))), np.repeat(np.arange(len(head)), np.diff(np.append(head, len(o))))


def _spans(owner: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, first window, last window) of the runs of consecutive windows."""
    order = np.lexsort((start, owner))
    owner, start = owner[order], start[order]
    if not len(owner):
        return owner, start, start
    head = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (start[1:] > start[:-1] + 1))))
    last = np.append(head[1:], len(owner)) - 1
    return owner[head], start[head], start[last]


def _count_bucket(table: pa.Table, span: int) -> pa.Table:
    """Shared windows of one bucket of super-k-mers: sorted, counted, and compared character by character."""
    strings = table.column("packed").to_pylist()
    rep, begin = np.asarray(table.column("rep")), np.asarray(table.column("first"))
    out: list[tuple[np.ndarray, np.ndarray]] = []
    keys = np.asarray(table.column("minimiser"))
    order = np.argsort(keys, kind="stable")
    # pieces of whole minimisers, so that memory depends on neither the bucket's nor the batch's size
    at, size, cut = 0, 0, []
    for i, k in enumerate(order):
        size += len(strings[k])
        if size > 1 << 20 and i + 1 < len(order) and keys[order[i + 1]] != keys[k]:
            cut.append(order[at : i + 1])
            at, size = i + 1, 0
    cut.append(order[at:])
    for own in cut:
        cps, of, within, at_cp, h1, h2 = _windows([strings[k] for k in own], span)
        owner, start = rep[own][of], begin[own][of] + within
        by, shared, group = _marked(h1, h2, owner)
        by, group = by[shared], group[shared]
        _must_be_equal(cps, at_cp[by], group, span)
        out.append((owner[by], start[by]))
    owner, first, last = _spans(np.concatenate([o for o, _ in out]), np.concatenate([s for _, s in out]))
    return pa.table({"rep": pa.array(owner, pa.int64()), "lo": pa.array(first, pa.int64()), "hi": pa.array(last + span, pa.int64())})


def _must_be_equal(cps: np.ndarray, at: np.ndarray, group: np.ndarray, span: int) -> None:
    """Windows at ``at``, ordered by hash, with equal ``group`` must be equal strings; each is compared with the next."""
    for lo in range(0, max(0, len(at) - 1), 1 << 14):
        x, y = at[lo : lo + (1 << 14)], at[lo + 1 : lo + (1 << 14) + 1]
        same = group[lo : lo + len(y)] == group[lo + 1 : lo + 1 + len(y)]
        x, y = x[: len(y)][same], y[same]
        step = np.arange(span)
        if not np.array_equal(cps[x[:, None] + step], cps[y[:, None] + step]):
            raise RuntimeError(_COLLISION)


def _covered(found: DataFrame) -> DataFrame:
    """``doc_id, sum, longest`` of the union of the intervals ``rep, lo, hi`` of each document, as they stream by in order."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        held: tuple[list[int], list[int], list[int]] = ([], [], [])
        end = total = longest = begin = 0
        for b in batches:
            for rep, lo, hi in zip(*(b.column(i).to_pylist() for i in range(3))):
                if rep != own:
                    if own is not None:
                        for to, v in zip(held, (own, total, max(longest, end - begin))):
                            to.append(v)
                    own, begin, end, total, longest = rep, lo, hi, hi - lo, 0
                elif lo > end:
                    longest, begin, total, end = max(longest, end - begin), lo, total + hi - lo, hi
                elif hi > end:
                    total, end = total + hi - end, hi
            if held[0]:
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in held], names=["doc_id", "sum", "longest"])
                held = ([], [], [])
        if own is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in (own, total, max(longest, end - begin))], names=["doc_id", "sum", "longest"])

    return found.select("rep", "lo", "hi").repartition("rep").sortWithinPartitions("rep", "lo").mapInArrow(walk, "doc_id bigint, sum bigint, longest bigint")


def shared_spans(documents: DataFrame, span: int = 200, seed: int = 64, hot: int = 20_000, bucket_rows: int = 20_000, salts: int = 32) -> DataFrame:
    """``doc_id, n_chars, shared_chars, longest`` of each document: characters that lie in a span of at least
    ``span`` characters which occurs, character for character, in another document too.

    ``documents`` has ``doc_id`` (bigint, unique) and ``text``; other columns are ignored. Documents
    with one text are taken together first: of ``span`` characters or more, they are shared whole. Of the
    rest one document per text goes on. A minimiser met in one text only cannot belong to a shared
    window, so only super-k-mers of minimisers met in two texts or more are packed and sent; in their
    buckets windows are sorted and counted, and those of one hash compared character by character.
    Minimisers with more than ``hot`` super-k-mers (boilerplate in a large part of all documents) do not go to
    one task: their windows are counted by hash, combined before the shuffle and salted on the way back,
    and then compared character by character just the same.

    Null ids are left out; null, empty and short texts have nothing shared. A span that occurs twice in
    one document only is not shared. An empty table gives an empty result.
    """
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, part in chunks(b.column(1).to_pylist()):
                of, value, start, per = super_kmers(part, span, seed)
                at = np.searchsorted(of, np.arange(len(part) + 1))
                digest = np.frombuffer(b"".join(hashlib.md5(t.encode("utf-8", "surrogatepass")).digest() for t in part), np.int64).reshape(-1, 2)
                lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), v) for v in (pa.array(signed(value)), pa.array(start, pa.int32()), pa.array(per, pa.int32()))]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, len(part)), pa.array(np.ascontiguousarray(digest[:, 0])), pa.array(np.ascontiguousarray(digest[:, 1])), pa.array(list(map(len, part)), pa.int32()), *lists],
                    names=["doc_id", "d1", "d2", "n_chars", "minimisers", "first", "windows"],
                )

    ddl = "doc_id bigint, d1 bigint, d2 bigint, n_chars int, minimisers array<bigint>, first array<int>, windows array<int>"
    cuts = stage(docs.mapInArrow(cut, ddl), "span-cuts")
    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(salts)).cast("int").alias("salt")
    long = cuts.where(f"n_chars >= {span}")
    texts = stage(long.groupBy("d1", "d2", "n_chars").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "span-texts")
    # a text with a large part of all documents is one key, so its copies find it under their own salts
    repeated = texts.where("copies > 1").select("d1", "d2", "n_chars", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    whole = long.select("doc_id", "d1", "d2", "n_chars", salt("doc_id")).join(repeated, ["d1", "d2", "n_chars", "salt"])
    whole = whole.select("doc_id", F.col("n_chars").cast("bigint").alias("sum"), F.col("n_chars").cast("bigint").alias("longest"))

    # all copies of a text but one are left out; usually few, so that the long rows need not move
    copies = long.select("doc_id", "d1", "d2", "n_chars", salt("doc_id")).join(texts.where("copies > 1").select("d1", "d2", "n_chars", "rep", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")), ["d1", "d2", "n_chars", "salt"])
    copies = stage(copies.where("doc_id != rep").select("doc_id"), "span-copies")
    reps = long.join(copies, "doc_id", "left_anti")
    pieces = reps.select(F.col("doc_id").alias("rep"), F.inline(F.arrays_zip("minimisers", "first", "windows")).alias("minimiser", "first", "windows"))
    common = pieces.groupBy("minimiser").agg(F.count("*").alias("met"), F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo != hi").select("minimiser", "met")
    common = stage(common, "span-minimisers")
    total = cuts.agg(F.sum(F.size("minimisers"))).first()[0] or 0
    wanted = join_counted(pieces, common, "minimiser", "met", total)
    wanted = wanted.groupBy("rep").agg(F.collect_list(F.struct("minimiser", "first", "windows", "met")).alias("wanted"))  # of one document, fewer than its characters
    wanted = stage(wanted, "span-wanted")
    some = docs.join(stage(wanted.select(F.col("rep").alias("doc_id")), "span-wanted-ids"), "doc_id", "left_semi")  # only these texts are sent
    sent = some.join(wanted, F.col("doc_id") == F.col("rep")).select("rep", F.inline("wanted"), "text")
    packed = F.col("text").substr(F.col("first") + 1, F.col("windows") + (span - 1))
    packed = stage(sent.select("rep", "minimiser", "first", "met", packed.alias("packed")), "span-packed")

    rows = packed.where(f"met <= {hot}")
    buckets = max(1, -(-rows.count() // bucket_rows))
    found = rows.groupBy(F.pmod(F.xxhash64("minimiser"), F.lit(buckets)).alias("bucket")).applyInArrow(lambda t: _count_bucket(t, span), "rep bigint, lo bigint, hi bigint")
    often = packed.where(f"met > {hot}")
    if not often.isEmpty():
        found = found.unionByName(_hot_spans(often, span, salts))
    each = _covered(found).unionByName(whole).groupBy("doc_id").agg(F.max("sum").alias("sum"), F.max("longest").alias("longest"))
    return cuts.select("doc_id", "n_chars").join(each, "doc_id", "left").select("doc_id", "n_chars", F.coalesce("sum", F.lit(0).cast("bigint")).alias("shared_chars"), F.coalesce("longest", F.lit(0).cast("bigint")).alias("longest"))


def _windows(packed: list[str], span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code points, string, window within it, place, two hashes) of all windows of some strings."""
    sizes = np.fromiter(map(len, packed), np.int64, len(packed))
    per = sizes - span + 1
    cps = code_points(packed)
    of = np.repeat(np.arange(len(packed)), per)
    within = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    at = (np.cumsum(sizes) - sizes)[of] + within
    return cps, of, within, at, _window_hashes(cps, span)[at], _window_hashes(cps, span, 1 << 21)[at]


def _hot_spans(packed: DataFrame, span: int, salts: int) -> DataFrame:
    """``rep, lo, hi`` of shared stretches of hot minimisers' super-k-mers; no task gets all of one minimiser.

    Windows are counted by hash; of those that two documents have, the super-k-mers are read again: their
    windows are joined to stretches, and one string of each hash goes out of each batch (in which those of one
    hash were compared), so that all strings of a hash are compared with each other.
    """

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, part in chunks(b.column(2).to_pylist()):
                _, of, within, _, h1, h2 = _windows(part, span)
                rep, begin = (np.asarray(b.column(i))[first : first + len(part)] for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(rep[of]), pa.array(begin[of], pa.int32()), pa.array(within, pa.int32()), pa.array(signed(h1)), pa.array(signed(h2))], names=["rep", "first", "at", "h1", "h2"])

    each = packed.select("rep", "first", "packed").mapInArrow(hashes, "rep bigint, first int, at int, h1 bigint, h2 bigint")
    each = stage(each.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(salts)).cast("int")), "span-windows")
    parts = stage(each.groupBy("h1", "h2", "salt").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")), "span-window-parts")
    shared = parts.groupBy("h1", "h2").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo != hi").select("h1", "h2")
    marked = each.join(parts.select("h1", "h2", "salt").join(shared, ["h1", "h2"]), ["h1", "h2", "salt"])
    marked = marked.groupBy("rep", "first").agg(F.collect_list("at").alias("at"))  # of one super-k-mer, fewer than its minimiser has places

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                part = b.slice(lo, 2048)
                rep, begin = (np.asarray(part.column(i)) for i in (0, 1))
                cps, of, within, place, h1, h2 = _windows(part.column(2).to_pylist(), span)
                wanted = part.column(3)
                ends = np.asarray(wanted.offsets)
                sizes = np.bincount(of, minlength=part.num_rows)
                own = np.repeat((np.cumsum(sizes) - sizes), np.diff(ends)) + np.asarray(wanted.values)[ends[0] : ends[-1]]
                own = own[np.lexsort((h2[own], h1[own]))]
                new = np.concatenate(([True], (h1[own][1:] != h1[own][:-1]) | (h2[own][1:] != h2[own][:-1])))
                _must_be_equal(cps, place[own], np.cumsum(new), span)
                one = own[new]
                text = [cps[p : p + span].tobytes().decode("utf-32-le", "surrogatepass") for p in place[one]]
                owner, first, last = _spans(of[own], within[own])
                n, m = len(owner), len(one)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate((rep[owner], np.zeros(m, np.int64)))), pa.array(np.concatenate((begin[owner] + first, np.zeros(m, np.int64)))), pa.array(np.concatenate((begin[owner] + last + span, np.zeros(m, np.int64)))),
                        pa.array(np.concatenate((np.zeros(n, np.int64), signed(h1[one])))), pa.array(np.concatenate((np.zeros(n, np.int64), signed(h2[one])))), pa.array([None] * n + text, pa.string()),
                    ],
                    names=["rep", "lo", "hi", "h1", "h2", "window"],
                )

    read = packed.join(marked, ["rep", "first"]).select("rep", "first", "packed", "at").mapInArrow(stretches, "rep bigint, lo bigint, hi bigint, h1 bigint, h2 bigint, window string")
    read = stage(read, "span-hot")
    if not read.where("window is not null").groupBy("h1", "h2").agg(F.min("window").alias("x"), F.max("window").alias("y")).where("x != y").isEmpty():
        raise RuntimeError(_COLLISION)
    return read.where("window is null").select("rep", "lo", "hi")
