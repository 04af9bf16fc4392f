"""Text normalisation, word shingles and set similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ids import seed31

#: Markers of problems that need a picture.
VISUAL_MARKERS = [r"!\[", r"https?://\S+\.(?:png|jpe?g|gif|svg)", r"\bfigure\b", r"\bdiagram\b"]
#: Addresses, and what is no letter, digit or Chinese character.
ADDRESS, OTHER_SIGNS = r"https?://\S+", r"[^a-z0-9\u4e00-\u9fff]+"
#: Fixed value: layout commands that say nothing.
LAYOUT_COMMANDS = r"\\(?:left|right|displaystyle|textstyle)"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    """Without white space of any kind at both ends (``trim`` removes blanks only)."""
    return F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", "")


def text_or_empty(c: str | Column) -> Column:
    return F.coalesce(_col(c).cast("string"), F.lit(""))


def normalize_text(c: str | Column) -> Column:
    """Lower case; URLs, layout commands and all but a-z, 0-9 and Chinese characters become single blanks. Null becomes ''."""
    out = F.lower(text_or_empty(c))
    out = F.regexp_replace(out, "(?U)" + ADDRESS, " ")
    out = F.regexp_replace(out, LAYOUT_COMMANDS, " ")
    out = F.regexp_replace(out, OTHER_SIGNS, " ")
    return F.trim(out)


def is_text_only(c: str | Column) -> Column:
    """False where a picture, an image link, or the words figure or diagram occur."""
    return ~text_or_empty(c).rlike("(?iU)" + "|".join(VISUAL_MARKERS))


def shingles(c: str | Column, size: int = 5, normalized: bool = False) -> Column:
    """Distinct runs of ``size`` words of the normalised text; all words of a shorter one; none of an empty one.

    The words are bound once by ``transform`` over a one-element array: written inside the inner lambda
    they would be split again for every position.
    """
    text = _col(c) if normalized else normalize_text(c)
    runs = lambda w: F.when(F.size(w) < size, F.array(F.array_join(w, " "))).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(w) - size + 1), lambda i: F.array_join(F.slice(w, i, size), " "))
    )
    each = F.flatten(F.transform(F.array(F.split(text, " ")), runs))
    return F.filter(F.array_distinct(each), lambda s: s != "")


def minhash(c: str | Column, permutations: int = 128, size: int = 5) -> Column:
    """The signature of a text's shingles: for each of ``permutations`` linear maps modulo ``2**31 - 1`` the least image of their hashes.

    Two texts agree at a place with a chance near the Jaccard index of their shingles. Null for a text without shingles.
    The maps' coefficients are hashes of their numbers, so signatures are the same everywhere.
    """
    number = F.sequence(F.lit(0), F.lit(permutations - 1))
    hashes = F.transform(shingles(c, size), lambda s: seed31(s))
    maps = F.transform(number, lambda i: F.struct((seed31(F.lit("a"), i) + 1).alias("a"), seed31(F.lit("b"), i).alias("b")))
    made = F.transform(F.array(hashes), lambda h: F.transform(maps, lambda m: F.array_min(F.transform(h, lambda x: (m["a"] * x + m["b"]) % F.lit(0x7FFFFFFF)))))[0]
    return F.when(F.size(hashes) > 0, made)


def agreement(a: str | Column, b: str | Column) -> Column:
    """Share of the places at which two signatures agree; 0 if one is null."""
    same = F.size(F.filter(F.zip_with(_col(a), _col(b), lambda x, y: x == y), lambda e: e)) / F.size(_col(a))
    return F.when(_col(a).isNotNull() & _col(b).isNotNull(), same).otherwise(0.0)


def jaccard(a: str | Column, b: str | Column) -> Column:
    """Jaccard index of two arrays of distinct values, 0 if either is empty or null."""
    a, b = _col(a), _col(b)
    common = F.size(F.array_intersect(a, b))
    index = common / (F.size(a) + F.size(b) - common)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), index).otherwise(F.lit(0.0))
