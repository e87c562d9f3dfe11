"""Hashes of words and of runs of words, for many texts at once in numpy."""

from __future__ import annotations

import numpy as np

from promptroute.llm.decontaminate import split_words

WORDS = 5
_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEPS = tuple(
    np.uint64(x)
    for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)
)


def mix(x: np.ndarray) -> np.ndarray:
    """Well spread 64-bit values, one for each of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
_BYTES = mix(np.arange(256, dtype=np.uint64) + _ODD)


def powers(base: np.uint64, n: int) -> np.ndarray:
    """The first ``n`` powers of ``base``; tables made once serve all shorter ones."""
    known = _POWERS.get(int(base))
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 16), base, np.uint64)
        known[0] = 1
        known = np.multiply.accumulate(known)
        if n <= 1 << 22:
            _POWERS[int(base)] = known
    return known[:n]


_POWERS: dict[int, np.ndarray] = {}


def word_hashes(text: str) -> np.ndarray:
    """A hash for each word of a text, in order."""
    words = split_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    line = np.frombuffer(b" ".join(words), np.uint8)
    sums = np.zeros(len(line) + 1, np.uint64)
    np.cumsum(_BYTES[line] * powers(_ODD, len(line)), out=sums[1:])
    gaps = np.flatnonzero(line == 0x20)
    starts = np.concatenate([[0], gaps + 1])
    stops = np.concatenate([gaps, [len(line)]])
    inverse = powers(_INVERSE, len(line))
    return mix((sums[stops] - sums[starts]) * inverse[starts] + (stops - starts).astype(np.uint64))


def shingles(text: str, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the runs of ``words`` words of a text, and how often each stands in it.

    A text of fewer words, but not none, has one run: all its words.
    """
    each = word_hashes(text)
    if not len(each):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    width = min(words, len(each))
    n = len(each) - width + 1
    runs = np.full(n, width, np.uint64)
    for k in range(width):
        runs = mix(runs * _STEPS[k % len(_STEPS)] + each[k : k + n])
    return np.unique(runs, return_counts=True)
