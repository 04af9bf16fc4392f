"""Problem 8: mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranks import hash_bucket, permuted, ranked
from ..operators.staging import stage

#: How a rank file's vocabulary splits text before its merges: the fixed pattern of that public vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
GOLDEN = 0.6180339887498949


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, keep: list[str], text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``keep`` and ``tokens``, the number of tokens of the whole text; null and empty texts have 0."""
    schema = documents.select(*keep).schema
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", tokens bigint"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(vocabulary).encode_ordinary
        for b in batches:
            sizes = pa.array([len(encode(t)) if t else 0 for t in b.column(len(keep)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), sizes], names=[*keep, "tokens"])

    return documents.select(*keep, text).mapInArrow(count, ddl)


def slack(slots: Column) -> Column:
    """By how many slots, at most, a source's number differs from its weight times ``slots``: a bound on the discrepancy of golden-ratio points."""
    return 3 + 1.5 * F.log2(slots + 2)


def schedule(weights: DataFrame, slots: int) -> DataFrame:
    """``slot, _key, rank``: slot i goes to the source whose stretch of the cumulative weights holds frac(i * golden ratio).

    ``weights`` has ``_key`` and ``weight``, one row a source. ``rank`` numbers the slots of a source. Each source's
    share of any stretch of slots is close to its weight (see :func:`slack`). The cumulative weights are summed in
    one task, of one row a source; slots meet them by equal cells of the unit interval, so the cost of a slot
    does not grow with the number of sources.
    """
    spark = weights.sparkSession
    along = Window.orderBy("_key")
    sums = weights.where("weight > 0").select("_key", F.sum("weight").over(along).alias("_to"), F.sum("weight").over(Window.partitionBy()).alias("_all"))
    ends = sums.select("_key", (F.col("_to") / F.col("_all")).alias("hi"), F.coalesce(F.lag(F.col("_to") / F.col("_all")).over(along), F.lit(0.0)).alias("lo"), (F.lead("_key").over(along).isNull()).alias("last"))
    ends = ends.withColumn("hi", F.when(F.col("last"), 2.0).otherwise(F.col("hi")))
    cells = max(1, 4 * weights.count())
    cell = lambda c: F.least(F.floor(c * cells), F.lit(cells - 1)).cast("int")
    ends = ends.withColumn("cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.least("hi", F.lit(1.0))))))
    points = spark.range(slots).select(F.col("id").alias("slot"), ((F.col("id") * GOLDEN) % 1.0).alias("point")).withColumn("cell", cell(F.col("point")))
    each = points.join(ends, "cell").where("lo <= point and point < hi").select("slot", "_key")
    return ranked(each, ["_key"], F.floor(F.col("slot") / 65_536), ["slot"])


def mix_sources(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, block_tokens: int = 16_384, seed: int = 7, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(mix, report): documents in the order of a schedule that gives each source its target share.

    ``documents`` has ``doc_id``, ``source`` and ``text``; ``targets`` has ``source``, ``target_share`` and
    ``max_repeats``; sources are compared trimmed and lower-cased. Each source's documents, in a keyed
    shuffled order, form a sequence that is repeated up to ``max_repeats`` times and cut into blocks
    of ``block_tokens`` tokens (a document belongs to the block in which it starts). The n-th slot of a
    source in the schedule takes its n-th block; slots beyond the last one stay empty.

    mix: ``slot, source, doc_id, repeat, tokens``. report: one row per source of the targets with
    ``target_tokens``, ``available_tokens``, ``capacity_tokens`` (with repeats), ``slots`` of the schedule, ``blocks``
    to fill them, ``short``, ``actual_tokens`` and ``actual_share``. A source is short if the schedule has as many
    slots for it as there are blocks (within its :func:`slack`) and its capacity is below its share of all
    tokens; a source with the second has the first. ``total_tokens`` is the size of the mix, by default that of
    all documents.

    Documents without tokens or source are in no mix; a null ``max_repeats`` counts as 1, a null share as
    0. Repeated target rows count once; of rows that differ but name one source the shares are added, and the
    largest ``max_repeats`` and the first name hold. A source without documents is short if its share is above
    0. Empty tables give an empty mix.
    """
    source = F.lower(F.trim("source"))
    rows = targets.where("source is not null").select("source", source.alias("_key"), F.coalesce("target_share", F.lit(0.0)).alias("share"), F.coalesce("max_repeats", F.lit(1)).alias("repeats")).distinct()
    rows = rows.groupBy("_key").agg(F.min("source").alias("source"), F.sum("share").alias("share"), F.max("repeats").alias("repeats"))
    counted = stage(token_counts(documents.select("doc_id", source.alias("_key"), "text"), ["doc_id", "_key"], "text", vocabulary), "mix-tokens")
    every = counted.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    total = every if total_tokens is None else total_tokens
    sums = counted.groupBy("_key").agg(F.sum("tokens").alias("available_tokens"))
    goals = stage(rows.join(sums, "_key", "left").fillna(0, ["available_tokens"]), "mix-goals")

    n = -(-total // block_tokens)
    slots = stage(schedule(goals.select("_key", F.col("share").alias("weight")), n), "mix-schedule")
    taken = slots.groupBy("_key").agg(F.count("*").alias("slots"))
    capacity = F.col("repeats") * F.col("available_tokens")
    goals = goals.join(taken, "_key", "left").fillna(0, ["slots"]).withColumn("blocks", F.ceil(capacity / block_tokens))
    # no more repeats than the slots can take
    needed = goals.where("slots > 0 and available_tokens > 0").select("_key", "available_tokens", F.least("repeats", F.ceil(F.col("slots") * block_tokens / F.col("available_tokens"))).cast("int").alias("_used"))
    ordered = counted.where("tokens > 0 and _key is not null").withColumn("_order", permuted(seed, "doc_id"))
    placed = ranked(ordered, ["_key"], hash_bucket("_order"), ["_order", "doc_id"], "tokens").drop("rank", "_order")
    again = placed.join(needed.where("_used > 0"), "_key").withColumn("repeat", F.explode(F.sequence(F.lit(0), F.col("_used") - 1)))
    blocks = again.withColumn("rank", F.floor((F.col("repeat") * F.col("available_tokens") + F.col("before")) / block_tokens))
    mix = stage(blocks.join(slots, ["_key", "rank"]).select("slot", "_key", "doc_id", "repeat", "tokens"), "mix")

    actual = mix.groupBy("_key").agg(F.sum("tokens").alias("actual_tokens"))
    whole = mix.agg(F.sum("tokens")).first()[0] or 1
    weights = goals.agg(F.sum("share")).first()[0] or 1.0
    asked = (F.col("slots") + slack(F.lit(n))) * max(1.0, float(weights)) * (every / total if total else 1.0)
    report = goals.join(actual, "_key", "left").fillna(0, ["actual_tokens"]).select(
        "source", F.col("share").alias("target_share"), F.col("repeats").alias("max_repeats"), "available_tokens",
        (F.col("share") * total).alias("target_tokens"), capacity.alias("capacity_tokens"), "slots", "blocks",
        ((F.col("blocks") <= asked) & (capacity < F.col("share") * every)).alias("short"),
        "actual_tokens", (F.col("actual_tokens") / whole).alias("actual_share"),
    )
    return mix.join(goals.select("_key", "source"), "_key").select("slot", "source", "doc_id", "repeat", "tokens"), report
