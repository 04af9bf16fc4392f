"""Exact deduplication and checks of uniqueness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import text_or_empty


def _named(key: Column) -> list[Column]:
    """A key of any size as 128 bits; null is a key of its own."""
    return [key.isNull().alias("_null"), F.xxhash64(key).alias("_key1"), F.xxhash64(F.lit(1), key).alias("_key2")]


def keep_first(df: DataFrame, key: Column, order: Column) -> DataFrame:
    """The row with the least ``order`` of each key. Rows with a null key count as one key.

    A grouped minimum: each task keeps one row a key before the shuffle, so a key with a third of all rows
    costs one row a task (a window would move and sort them all). Keys are compared by 128 bits, so what is
    sorted is two numbers, however long the key.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    return df.groupBy(*_named(key)).agg(F.min_by(row, order).alias("row")).select("row.*")


def keep_least(df: DataFrame, key: Column, identifier: str) -> DataFrame:
    """The row with the least ``identifier``, which is unique and not null, of each key; a null key counts as one key.

    Only the key's 128 bits and the identifier are grouped. The other columns are read again for the semi-join,
    so neither a long key nor the row goes through the grouping.
    """
    least = df.groupBy(*_named(key)).agg(F.min(identifier).alias(identifier)).select(identifier)
    return df.join(least, identifier, "left_semi")


def drop_matching(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """Rows without a partner: what is still to be done, given what is done."""
    return df.join(other.select(*on).distinct(), on, "left_anti")


def duplicates(df: DataFrame, key: str | Column) -> DataFrame:
    """``id, n`` of ids that occur more than once; null ids don't count."""
    key = F.col(key) if isinstance(key, str) else key
    return df.groupBy(key.alias("id")).agg(F.count("*").alias("n")).where("id is not null and n > 1")


def record_id(plain: Column | None, nested: Column | None) -> Column:
    """A record's id: ``plain`` (a pool's ``sample_id``) where there is one that is not empty, else ``nested`` (a view's ``extra_info.sample_id``)."""
    filled = F.lit(None).cast("string") if plain is None else F.when(text_or_empty(plain) != "", plain)
    return filled if nested is None else F.coalesce(filled, nested)
