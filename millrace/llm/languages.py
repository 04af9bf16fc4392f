"""Languages of texts: by script where a script tells, else by a fitted model of runs of letters."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.staging import stage
from ..operators.words import U, chunks, code_points, mix

FORMULA = re.compile(r"\$[^$\n]{1,80}\$|\\[A-Za-z]+|\\[()\[\]]")
#: The ranges of code points of scripts that tell a language, or a few close ones.
SCRIPTS = {
    "ru": [(0x400, 0x4FF)], "el": [(0x370, 0x3FF)], "he": [(0x590, 0x5FF)], "ar": [(0x600, 0x6FF)], "hi": [(0x900, 0x97F)], "th": [(0xE00, 0xE7F)],
    "ja": [(0x3040, 0x30FF)], "ko": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)], "zh": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)],
}
_NAMES = list(SCRIPTS)
_BITS = 16
_LATIN, _NONE = 255, 254
_tables: list[np.ndarray] = []


def _kinds() -> np.ndarray:
    """By code point up to U+FFFF: the number of a script, Latin letter, or neither."""
    if not _tables:
        kind = np.full(0x10000, _NONE, np.uint8)
        for i in [*range(0x41, 0x250), *range(0x1E00, 0x1F00)]:
            if chr(i).isalpha():
                kind[i] = _LATIN
        for k, spans in enumerate(SCRIPTS.values()):
            for low, high in spans:
                kind[low : high + 1] = k
        _tables.append(kind)
    return _tables[0]


def prose(text: str) -> str:
    """The text without formulas and commands."""
    return FORMULA.sub(" ", text) if "$" in text or "\\" in text else text


@dataclass
class Grams:
    """Runs of three Latin letters (a blank for all else) and letters by script, of some texts."""

    gram: np.ndarray  # places in the table
    text: np.ndarray  # whose they are
    scripts: np.ndarray  # letters of each script, a row a text; the last column is Latin

    @classmethod
    def of(cls, texts: list[str]) -> Grams:
        bare = [" " + prose(t).lower() + " " for t in texts]
        cps = code_points(bare)
        of = np.repeat(np.arange(len(bare)), np.fromiter(map(len, bare), np.int64, len(bare)))
        kind = _kinds()[np.minimum(cps, 0xFFFF)]
        columns = np.where(kind == _LATIN, len(_NAMES), kind).astype(np.int64)
        known = kind != _NONE
        scripts = np.bincount(of[known] * (len(_NAMES) + 1) + columns[known], minlength=len(bare) * (len(_NAMES) + 1)).reshape(len(bare), -1)
        letter = np.where(kind == _LATIN, cps, 32).astype(np.uint64)
        keep = np.concatenate((np.ones(min(1, len(letter)), bool), (letter[1:] != 32) | (letter[:-1] != 32) | (of[1:] != of[:-1])))
        letter, of = letter[keep], of[keep]
        m = max(0, len(letter) - 2)
        h = mix((letter[:m] << U(42)) | (letter[1 : m + 1] << U(21)) | letter[2 : m + 2]) >> U(64 - _BITS)
        same = of[:m] == of[2 : m + 2]
        return cls(h[same].astype(np.int64), of[:m][same], scripts)


@dataclass
class LanguageModel:
    """Log chances of letter runs in each language written in Latin letters."""

    names: list[str]
    table: np.ndarray  # one column a language

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(letters by script, letter runs, sum of log chances by language) of each text."""
        g = Grams.of(texts)
        runs = np.bincount(g.text, minlength=len(texts))
        sums = np.stack([np.bincount(g.text, self.table[g.gram, k], len(texts)) for k in range(len(self.names))], 1) if self.names else np.zeros((len(texts), 0))
        return g.scripts, runs, sums

    @classmethod
    def fit(cls, counts: dict[str, np.ndarray]) -> LanguageModel:
        names = sorted(counts)
        columns = [np.log((counts[n] + 0.5) / (counts[n].sum() + 0.5 * len(counts[n]))) for n in names]
        return cls(names, np.stack(columns, 1).astype(np.float64) if names else np.zeros((1 << _BITS, 0)))


def fit_languages(labelled: DataFrame, labelled_rows: int = 4096, least_rows: int = 20, seed: int = 7) -> LanguageModel:
    """A model from the ``labelled_rows`` rows of ``text`` and ``lang`` with the smallest keyed hash.

    The bound is a parameter and does not grow with the input; what reaches the driver is one table of counts for
    each language. Labels are trimmed and lower-cased; those with fewer than ``least_rows`` rows of the
    sample, and texts that are mostly in another script than Latin, are left out. Some labels are wrong, so the
    sample is labelled again by the first model and fitted once more. Without rows the model knows no language.
    """
    rows = labelled.select(F.lower(F.trim("lang")).alias("lang"), "text").where("lang != '' and text != ''")
    rank = F.xxhash64(F.lit(seed), "text")
    total = rows.count()
    cut = 4 * labelled_rows / total if total > 8 * labelled_rows else 1
    low = rows.where(rank < F.lit(int(cut * 2**64) - 2**63)) if cut < 1 else rows
    sample = stage(low.select(rank.alias("rank"), "lang", "text").orderBy("rank", "lang").limit(labelled_rows), "language-sample")
    spaced = F.length("text") > 2 * F.length(F.regexp_replace("text", r"\p{IsLatin}", ""))  # mostly Latin letters
    often = {r["lang"] for r in sample.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(spaced).alias("latin")).where(f"latin >= {least_rows} and 2 * latin > n").collect()}

    def counts(model: LanguageModel | None) -> dict[str, np.ndarray]:
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[str, np.ndarray] = {}
            for b in batches:
                for first, part in chunks(b.column(1).to_pylist()):
                    names = b.column(0).slice(first, len(part)).to_pylist()
                    g = Grams.of(part)
                    if model:
                        best = model.scores(part)[2].argmax(1)
                        names = [model.names[k] for k in best]
                    latin = g.scripts[:, -1] * 2 > g.scripts.sum(1)
                    for name in set(names) & often:
                        own = np.array([n == name for n in names]) & latin
                        sums[name] = sums.get(name, 0) + np.bincount(g.gram[own[g.text]], minlength=1 << _BITS)
            some = {n: s for n, s in sums.items() if s.any()}
            yield pa.RecordBatch.from_arrays([pa.array(list(some), pa.string()), pa.array([s.astype(np.int64).tobytes() for s in some.values()], pa.binary())], names=["lang", "counts"])

        out: dict[str, np.ndarray] = {}
        for r in sample.select("lang", "text").mapInArrow(count, "lang string, counts binary").collect():  # a table a language and task
            out[r["lang"]] = out.get(r["lang"], 0) + np.frombuffer(r["counts"], np.int64)
        return out

    first = LanguageModel.fit(counts(None))
    return LanguageModel.fit(counts(first)) if first.names else first


def other_language(model: LanguageModel, problems: list[str], solutions: list[str], least: int = 12, margin: float = 0.3) -> np.ndarray:
    """Whether most of each solution is clearly in another language than its problem.

    The language of a text is that of the script of most of its letters. Where this is Latin for both, the solution's
    letter runs must, on average, be likelier in some language than in the problem's by ``margin`` (in logarithms), and the
    problem's likeliest in its own. Texts of fewer than ``least`` Latin letter runs, or letters of other scripts, say nothing.
    """
    (ps, pn, pl), (ss, sn, sl) = model.scores(problems), model.scores(solutions)

    def script(counts: np.ndarray) -> np.ndarray:
        weighed = counts.astype(float)
        weighed[:, [_NAMES.index(n) for n in ("zh", "ja", "ko")]] *= 3  # a sign says as much as some letters
        kana, han = _NAMES.index("ja"), _NAMES.index("zh")
        japanese = counts[:, kana] * 5 > counts[:, han]
        weighed[japanese, kana] += weighed[japanese, han]
        weighed[japanese, han] = 0
        best = weighed.argmax(1)
        return np.where(weighed.sum(1) >= least, np.where(weighed.max(1) * 2 > weighed.sum(1), best, -1), -1)

    a, b = script(ps), script(ss)
    out = (a >= 0) & (b >= 0) & (a != b)
    if len(model.names) > 1:
        both = (a == len(_NAMES)) & (b == len(_NAMES)) & (pn >= least) & (sn >= least)
        own = pl.argmax(1)
        at = np.arange(len(own))
        gain = (sl.max(1) - sl[at, own]) / np.maximum(sn, 1)
        out |= both & (gain >= margin)
    return out
