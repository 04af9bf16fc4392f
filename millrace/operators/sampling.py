"""Deterministic sampling, quotas and splits by hash rank, without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import rank_key
from .ranks import hash_bucket, ranked
from .staging import stage


def cap_by_group(df: DataFrame, group: list[str], key: str, limit: int, seed: int) -> DataFrame:
    """``limit`` rows of each group (all if 0), those with the lowest keyed hash of ``key``."""
    if limit <= 0:
        return df
    rows = df.withColumn("_order", rank_key(seed, key))
    return ranked(rows, group, hash_bucket("_order"), ["_order", key]).where(F.col("rank") < limit).drop("_order", "rank")


def take(df: DataFrame, key: str, limit: int, seed: int) -> DataFrame:
    """A sample of ``limit`` rows, those with the lowest keyed hash of ``key``: the same on every run.

    The rows are counted first, so that only those with a hash low enough to matter (about twice
    ``limit``) are sorted, however many tasks there are.
    """
    order = rank_key(seed, key)
    keyed = stage(df.select(key, order.alias("_order")), "sample-keys")  # the input is read for its keys once, then for the rows taken
    rows = keyed.count()
    low = keyed.where(F.col("_order") < f"{2 * limit * 16**12 // rows:012x}") if rows > 4 * limit else keyed
    if rows > 4 * limit and low.count() < limit:
        low = keyed
    last = low.orderBy("_order", key).limit(limit).agg(F.max("_order")).first()[0]
    return df.where(order <= F.lit(last)).orderBy(order, key).limit(limit)


def first_by(df: DataFrame, key: str, limit: int) -> DataFrame:
    """The ``limit`` rows with the least keys (all if 0): each task sends that many at most."""
    return df.orderBy(key).limit(limit) if limit > 0 else df


def canonical_order(df: DataFrame, keys: list[str]) -> DataFrame:
    """Sorted for writing: by ranges of the keys, in parallel."""
    return df.orderBy(*keys)


def quotas_with_transfer(available: DataFrame, quotas: dict[str, int], from_source: str, to_source: str) -> DataFrame:
    """``source, available, quota``: what ``from_source`` lacks is asked of ``to_source`` instead.

    ``available`` has ``source`` and ``available``. Raises no error: a quota above what is available shows in the row.
    """
    wanted = available.sparkSession.createDataFrame(list(quotas.items()), "source string, requested bigint")
    joined = wanted.join(available, "source", "left").fillna(0, ["available"])
    lacking = F.greatest(F.lit(0), F.max(F.when(F.col("source") == from_source, F.col("requested") - F.col("available"))).over(Window.partitionBy()))
    quota = F.col("requested") + F.when(F.col("source") == from_source, -lacking).when(F.col("source") == to_source, lacking).otherwise(0)
    return joined.select("source", "available", quota.alias("quota"))


def require_quotas(quotas: DataFrame) -> DataFrame:
    """``quotas`` of :func:`quotas_with_transfer`; ValueError if a source has fewer rows than its quota."""
    if short := quotas.where("available < quota").collect():  # one row a source
        raise ValueError("not enough rows: " + ", ".join(f"{r['source']} {r['available']}/{r['quota']}" for r in sorted(short)))
    return quotas


def quota_sample(df: DataFrame, source: str, key: str, quotas: DataFrame, seed: int) -> DataFrame:
    """``quota`` rows of each source in ``quotas``, by keyed hash."""
    rows = df.withColumn("_order", rank_key(seed, key)).join(quotas.select(F.col("source").alias(source), "quota"), source)
    return ranked(rows, [source], hash_bucket("_order"), ["_order", key]).where("rank < quota").drop("_order", "rank", "quota")


def assign_split(df: DataFrame, key: str, sizes: list[tuple[str, int]], rest: str, seed: int) -> DataFrame:
    """Adds ``split``: the first rows by keyed hash get the first name, and so on; those left over get ``rest``."""
    rows = df.withColumn("_order", rank_key(seed, key)).withColumn("_all", F.lit(0))
    rows = ranked(rows, ["_all"], hash_bucket("_order"), ["_order", key])
    split: Column = F.lit(rest)
    for name, end in reversed([(n, sum(s for _, s in sizes[: i + 1])) for i, (n, _) in enumerate(sizes)]):
        split = F.when(F.col("rank") < end, name).otherwise(split)
    return rows.withColumn("split", split).drop("_order", "_all", "rank")


def nested_positions(df: DataFrame, key: str, strata: list[str], seed: int) -> DataFrame:
    """Adds ``position`` (1 for the first) in an order that interleaves the strata evenly, and ``total``.

    Each stratum is ordered by keyed hash; a row's quantile in it orders all rows. Any prefix has nearly the
    strata's proportions, and prefixes are nested. The global position comes from counts by quantile
    bucket, so no task sorts all rows.
    """
    names = [f"_stratum{i}" for i in range(len(strata))]
    rows = df.withColumns({n: F.coalesce(F.col(c).cast("string"), F.lit("None")) for n, c in zip(names, strata)} | {"_order": rank_key(seed, key)})
    rows = ranked(rows, names, hash_bucket("_order"), ["_order", key])
    sizes = rows.groupBy(*names).agg(F.count("*").alias("_size"))
    rows = rows.join(sizes, names)
    rows = rows.withColumn("_quantile", (F.col("rank") + 0.5) / F.col("_size")).drop("rank", "_size", *names).withColumn("_all", F.lit(0))
    rows = ranked(rows, ["_all"], F.floor(F.col("_quantile") * 4096), ["_quantile", "_order", key])
    total = df.agg(F.count("*").alias("total"))
    return rows.withColumn("position", F.col("rank") + 1).drop("rank", "_quantile", "_order", "_all").crossJoin(F.broadcast(total))


def in_ratio(ratio: float | Column) -> Column:
    """Whether a row of :func:`nested_positions` is among the first ``ratio`` of all, rounded half to even."""
    ratio = ratio if isinstance(ratio, Column) else F.lit(float(ratio))
    return F.col("position") <= F.bround(F.col("total") * ratio, 0)
