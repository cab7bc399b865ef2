"""Vectorised words: hashes of the normalised words of many texts at once.

A word is an unbroken run of letters or digits; markup tags, punctuation, spacing, case and accents do not count.
Texts are laid end to end as code points, folded through one lookup table, and every word gets a 64-bit polynomial
hash from prefix sums, so that no Python loop runs over words or characters.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np

TAG = re.compile(r"<[^<>]*>")
#: What a code point folds to, where that is not one letter or digit.
APART, THROUGH, LONG = 0, 1, 2
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_SHIFT = np.uint64(33)
#: Characters laid end to end at a time; a longer text is handled alone.
CHUNK = 500_000

_table: np.ndarray | None = None
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def fold_text(text: str) -> str:
    """Case and accents taken off, character by character, compatibility forms opened."""
    opened = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", text).casefold())
    return "".join(c for c in opened if unicodedata.category(c)[0] != "M")


def _fold_code(code: int) -> int:
    if 0xD800 <= code < 0xE000:
        return APART
    c = chr(code)
    if unicodedata.category(c)[0] == "M":
        return THROUGH
    folded = fold_text(c)
    if len(folded) == 1:
        return ord(folded) if folded.isalnum() else APART
    return LONG if any(map(str.isalnum, folded)) else APART


def fold_table() -> np.ndarray:
    """The folding of the basic plane, computed once in a process."""
    global _table
    if _table is None:
        _table = np.fromiter(map(_fold_code, range(0x10000)), np.uint32, 0x10000)
    return _table


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> _SHIFT)
    h = h * _MIX1
    h ^= h >> _SHIFT
    h *= _MIX2
    return h ^ (h >> _SHIFT)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        n = max(n, 2 * CHUNK)
        both = np.empty((2, n), np.uint64)
        both[0], both[1] = _BASE, _INVERSE
        both[:, 0] = 1
        np.multiply.accumulate(both, axis=1, out=both)
        _powers = both[0], both[1]
    return _powers


def chunks(texts: list[str | None], size: int = CHUNK) -> Iterator[slice]:
    """Runs of texts of together at most ``size`` characters (a longer text comes alone)."""
    start, total = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if total and total + n > size:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(texts):
        yield slice(start, len(texts))


def _fold(codes: np.ndarray) -> np.ndarray:
    table = fold_table()
    if not len(codes) or codes.max() < 0x10000:
        return table[codes]
    high = codes >= 0x10000
    folded = table[np.where(high, 0, codes)]
    rare, which = np.unique(codes[high], return_inverse=True)
    folded[high] = np.array([_fold_code(int(c)) for c in rare], np.uint32)[which]
    return folded


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of the texts, in order, and for each text where its words begin (one more at the end).

    A null text has no words.
    """
    if not texts:
        return np.empty(0, np.uint64), np.zeros(1, np.int64)
    clean = []
    for t in texts:
        if not t:
            clean.append("")
            continue
        if "<" in t:
            t = TAG.sub(" ", t)
        clean.append(t.replace("ß", "ss") if "ß" in t else t)
    codes = np.frombuffer(("\n".join(clean) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    folded = _fold(codes)
    lengths = np.fromiter(map(len, clean), np.int64, len(clean)) + 1
    if (folded == LONG).any():
        ends = np.cumsum(lengths)
        for i in np.unique(np.searchsorted(ends, np.nonzero(folded == LONG)[0], "right")):
            clean[i] = fold_text(clean[i])
        codes = np.frombuffer(("\n".join(clean) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        folded = _fold(codes)
        folded[folded == LONG] = APART
        lengths = np.fromiter(map(len, clean), np.int64, len(clean)) + 1
    ends = np.cumsum(lengths)
    if (folded == THROUGH).any():
        keep = folded != THROUGH
        ends = np.cumsum(keep)[ends - 1]
        folded = folded[keep]
    inside = np.zeros(len(folded) + 2, np.int8)
    inside[1:-1] = folded > LONG
    turns = np.diff(inside)
    first, last = np.nonzero(turns == 1)[0], np.nonzero(turns == -1)[0]
    up, down = powers(len(folded))
    sums = np.zeros(len(folded) + 1, np.uint64)
    np.cumsum(folded * up[: len(folded)], out=sums[1:])
    hashes = mix((sums[last] - sums[first]) * down[first])
    offsets = np.zeros(len(texts) + 1, np.int64)
    offsets[1:] = np.searchsorted(first, ends, "left")
    return hashes, offsets


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of ``width`` words; runs across texts are the caller's to leave out."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.full(n, np.uint64(width))
    for k in range(width):
        total *= np.uint64(_BASE)
        total += words[k : k + n]
    return mix(total)


def words_of(text: str | None) -> list[str]:
    """The words themselves, for tests and small checks: the plain form of ``word_hashes``."""
    folded = fold_text(TAG.sub(" ", text or ""))
    return "".join(c if c.isalnum() else " " for c in folded).split()
