"""Final answers: extraction, normal forms, comparison and rewards."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col, strip, text_or_empty

#: Words read as true and false.
TRUE_WORDS, FALSE_WORDS = ["1", "true", "yes", "y", "t"], ["0", "false", "no", "n", "f"]
#: Answers that cannot be graded.
UNGRADABLE = ["proof", "notfound", "invalid"]
#: Kinds of verdicts.
VERDICT_KINDS = ["valid", "underdetermined", "contradictory", "infeasible", "ambiguous_expression", "other_invalid"]


def extract_boxed(c: str | Column) -> Column:
    r"""Content of the last ``\boxed{...}`` with balanced braces, stripped; null if there is none or it never closes."""
    c = _col(c)
    tail = F.substring_index(c, "\\boxed{", -1)
    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(s: Column, ch: Column) -> Column:
        depth = s["depth"] + F.when(ch == "{", 1).when(ch == "}", -1).otherwise(0)
        at = s["at"] + 1
        return F.struct(depth.alias("depth"), at.alias("at"), F.when((s["end"] == 0) & (depth == 0), at).otherwise(s["end"]).alias("end"))

    end = F.aggregate(F.split(tail, ""), start, step)["end"]
    return F.when(c.contains("\\boxed{") & (end > 0), strip(tail.substr(F.lit(1), end - 1)))


#: Decides whether two answers (as two series of strings) are equal in a way that their normal forms don't show.
Equal = Callable[[pd.Series, pd.Series], pd.Series]

#: What the normal form of an answer replaces.
REPLACEMENTS = [(r"\dfrac", r"\frac"), (r"\tfrac", r"\frac"), ("$", ""), (" ", "")]


def _said(c: str | Column, also: tuple[str, ...] = ()) -> Column:
    """As text; null, and a zero of a number's type (or of the types ``also``), is ''. The text "0" is itself."""
    c = _col(c)
    numbers = ["tinyint", "smallint", "int", "bigint", "float", "double", *also]
    zero = F.typeof(c).isin(numbers) & F.coalesce(c.cast("string").isin("0", "0.0", "-0.0", "false"), F.lit(False))
    return F.when(zero, "").otherwise(text_or_empty(c))


def normalize_answer(c: str | Column) -> Column:
    r"""Stripped, lower case, ``\dfrac`` and ``\tfrac`` as ``\frac``, without dollars, blanks and closing punctuation; null and a number's 0 as ''."""
    out = F.lower(strip(_said(c, ("boolean",))))
    for old, new in REPLACEMENTS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.regexp_replace(out, "[.,;:]+$", "")


def _also_equal(equal: Equal | None, same: Column, a: Column, b: Column) -> Column:
    """``same``, or else equal by ``equal``, which sees only what ``same`` leaves open. Runs in Arrow batches."""
    if equal is None:
        return same

    @F.pandas_udf("boolean")
    def ask(x: pd.Series, y: pd.Series) -> pd.Series:
        open_ = x.notna() & y.notna()
        out = pd.Series(False, index=x.index)
        if open_.any():
            out[open_] = equal(x[open_], y[open_]).astype(bool)
        return out

    return same | ask(F.when(~same, a), F.when(~same, b))


def answer_matches(prediction: str | Column, reference: str | Column, equal: Equal | None = None) -> Column:
    """Whether two answers have the same normal form that isn't empty, or are ``equal`` (a symbolic comparison, say); False for null."""
    a, b = _col(prediction), _col(reference)
    p, r = normalize_answer(a), normalize_answer(b)
    return _also_equal(equal, a.isNotNull() & b.isNotNull() & (p != "") & (r != "") & (p == r), a.cast("string"), b.cast("string"))


def fallback_form(c: str | Column) -> Column:
    """The weaker normal form of the reward: lower case without dollars, blanks and closing punctuation."""
    out = F.replace(F.replace(F.lower(_col(c).cast("string")), F.lit("$"), F.lit("")), F.lit(" "), F.lit(""))
    return F.regexp_replace(out, "[.,;:]+$", "")


def compute_score(response: str | Column, truth: str | Column, equal: Equal | None = None) -> Column:
    """1.0 if the response's boxed content is ``equal`` to the truth or has its weaker normal form, else 0.0."""
    boxed = extract_boxed(text_or_empty(response))
    same = F.coalesce((boxed != "") & (fallback_form(boxed) == fallback_form(truth)), F.lit(False))
    return F.when(_also_equal(equal, same, F.when(boxed != "", boxed), _col(truth).cast("string")), 1.0).otherwise(0.0)


def gated_score(response: str | Column, truth: str | Column, question_valid: str | Column) -> Column:
    """As :func:`compute_score`, but 0.0 where the question is known to be invalid."""
    return F.when(_col(question_valid) == F.lit(False), 0.0).otherwise(compute_score(response, truth))


def parse_bool(c: str | Column) -> Column:
    """True or false words, any case, outer white space ignored; null for all else. A number's 0 says nothing, its 1 is true."""
    word = F.lower(strip(_said(c)))
    return F.when(word.isin(TRUE_WORDS), True).when(word.isin(FALSE_WORDS), False)


def is_parseable(c: str | Column, mode: str = "regex") -> Column:
    """Whether an answer can be graded: not empty or one of the ungradable words, and with a letter, digit or backslash.

    ``mode="reward"`` asks instead that the boxed answer earns the reward against itself.
    """
    word = strip(text_or_empty(c))
    usable = (word != "") & ~F.lower(word).isin(UNGRADABLE)
    if mode == "reward":
        return usable & (compute_score(F.concat(F.lit("\\boxed{"), word, F.lit("}")), word) == 1.0)
    return usable & word.rlike(r"[0-9a-zA-Z\\]")


def declared_invalid(c: str | Column) -> Column:
    return F.upper(strip(text_or_empty(c))) == "INVALID"


def verdict_kind(c: str | Column) -> Column:
    """One of the known kinds; anything else, null included, is ``other_invalid``."""
    return F.when(_col(c).isin(VERDICT_KINDS), _col(c)).otherwise("other_invalid")


def regime(matches: str | Column, k: int) -> Column:
    return F.when(_col(matches) == 0, "dead").when(_col(matches) == k, "pseudo_saturated").otherwise("deceptive_active")


def regime_probabilities(p: str | Column, k: str | Column | int) -> list[Column]:
    """Chances that k draws with success p are all failures, mixed, and all successes."""
    p, k = _col(p), F.lit(k) if isinstance(k, int) else _col(k)
    dead, full = F.pow(1 - p, k), F.pow(p, k)
    return [dead.alias("dead"), (1 - dead - full).alias("active"), full.alias("saturated")]
