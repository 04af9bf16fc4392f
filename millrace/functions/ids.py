"""Identifiers, seeds and orders by SHA-256: the same on every run, engine and partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "\x1f"


def joined(*parts: str | Column | int) -> Column:
    """Parts (column names, columns or literal numbers) joined by a separator; null is written None."""
    cols = [F.col(p) if isinstance(p, str) else p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.concat_ws(SEPARATOR, *(F.coalesce(c.cast("string"), F.lit("None")) for c in cols))


def stable_id(prefix: str, *parts: str | Column | int) -> Column:
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(joined(*parts), 256), 1, 16))


def seed31(*parts: str | Column | int) -> Column:
    """A number of 31 bits."""
    return F.conv(F.substring(F.sha2(joined(*parts), 256), 1, 8), 16, 10).cast("bigint").bitwiseAND(F.lit(0x7FFFFFFF).cast("bigint"))


def rank_key(seed: int, identifier: str | Column) -> Column:
    """A keyed pseudo-random order."""
    return F.sha2(joined(seed, identifier), 256)
