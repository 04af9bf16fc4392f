"""Words and runs of words of many texts at once, on arrays of code points.

Whole texts are processed, in chunks of about ``CHUNK`` characters so that a Python worker's memory
does not depend on Spark's batch size (a longer text is a chunk of its own). The hashes are 64-bit
polynomials over code points; two given runs of words collide with a chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np

CHUNK = 1 << 20
U = np.uint64
_BASE, _STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, U), np.ones(1, U))


@cache
def _is_word() -> np.ndarray:
    """By code point, whether it is a letter or digit."""
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, CHUNK + CHUNK // 4)
        both = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base, U)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        _powers = (both[0], both[1])
    return _powers[0][:n], _powers[1][:n]


def code_points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def prefix_hashes(cps: np.ndarray, salt: int = 0) -> np.ndarray:
    """``p`` for which ``(p[j] - p[i]) * inverse[i]`` is the hash of ``cps[i:j]``."""
    up, _ = powers(len(cps) + 1)
    v = (cps.astype(U) + U(1 + salt)) * U(_STEP)
    v ^= v >> U(29)
    v *= up[: len(cps)]
    p = np.zeros(len(cps) + 1, U)
    np.add.accumulate(v, out=p[1:])
    return p


def chunks(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """(index of the first, texts) of consecutive pieces; null counts as empty."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        held.append(t or "")
        size += len(held[-1]) + 1
        if size >= CHUNK:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


class Words:
    """The words of some texts: maximal runs of letters and digits after lower-casing.

    With ``blanks`` the texts are taken as they are and words are what stands between blanks.
    ``hash[k]`` is word k's; text i has the words ``at[i]`` to ``at[i + 1]``.
    """

    def __init__(self, texts: list[str], blanks: bool = False):
        lowered = [t + "\n" for t in texts] if blanks else [t.lower() + "\n" for t in texts]
        sizes = np.fromiter(map(len, lowered), np.int64, len(lowered))
        cps = code_points(lowered)
        word = cps > 32 if blanks else _is_word()[cps]
        edge = np.flatnonzero(word[1:] != word[:-1]) + 1
        if len(word) and word[0]:
            edge = np.concatenate(([0], edge))
        start, end = edge[::2], edge[1::2]
        p, (_, down) = prefix_hashes(cps), powers(len(cps) + 1)
        self.hash = mix((p[end] - p[start]) * down[start])
        self.start, self.end, self.cps = start, end, cps
        self.text_at = np.concatenate(([0], np.cumsum(sizes)))
        self.at = np.searchsorted(start, self.text_at)

    def counts(self) -> np.ndarray:
        return np.diff(self.at)

    def runs(self, n: int, short: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, hash, first word) of each run of ``n`` words, in order.

        ``short``: a text with fewer words, but any, has one run of all of them.
        """
        w, counts = self.hash, self.counts()
        m = max(0, len(w) - n + 1)
        h = np.zeros(m, U)
        factor = 1
        for k in range(n):
            h += w[k : k + m] * U(factor)
            factor = factor * _BASE & (1 << 64) - 1
        h = mix(h)
        text = np.repeat(np.arange(len(counts)), counts)
        ok = text[:m] == text[n - 1 : n - 1 + m]
        text, h, pos = text[:m][ok], h[ok], np.flatnonzero(ok)
        if short and len(few := np.flatnonzero((counts > 0) & (counts < n))):
            first = self.at[few]
            extra = np.zeros(len(few), U)
            for k in range(n - 1):
                has = counts[few] > k
                extra[has] += w[first[has] + k] * U(pow(_BASE, k, 1 << 64))
            extra = mix(extra + counts[few].astype(U) * U(_STEP))
            text, h, pos = np.concatenate((text, few)), np.concatenate((h, extra)), np.concatenate((pos, first))
            order = np.argsort(text, kind="stable")
            text, h, pos = text[order], h[order], pos[order]
        return text, h, pos


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def unsigned(x: np.ndarray) -> np.ndarray:
    return x.view(U)
