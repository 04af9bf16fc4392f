"""Joins whose keys may be very uneven."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys with more than one in so many rows are broadcast; there are fewer of them than this.
HEAVY = 100_000


def join_counted(rows: DataFrame, keyed: DataFrame, key: str, count: str, total: int, heavy: int = HEAVY) -> DataFrame:
    """``rows`` joined with ``keyed``, which has one row a key with the number of its rows in ``count``; ``total`` is at least the number of ``rows``.

    Keys with more than ``total / heavy`` rows, of which there are fewer than ``heavy``, are found by broadcast, so
    their rows stay where they are. The others are shuffled, and none of them is large.
    """
    large = F.broadcast(keyed.where(F.col(count) > total / heavy))  # fewer than ``heavy`` rows
    small = keyed.where(F.col(count) <= total / heavy)
    return rows.join(large, key).unionByName(rows.join(large.select(key), key, "left_anti").join(small, key))
