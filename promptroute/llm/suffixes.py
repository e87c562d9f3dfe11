"""Suffix arrays and common prefixes of a shard of bytes, in numpy."""

from __future__ import annotations

import numpy as np

#: Stands for the place before a suffix that is not among those in order.
NO_SUFFIX = -2
_BYTE_STEPS = np.uint64(1) << np.arange(8, 64, 8, dtype=np.uint64)


def packed(text: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as one number; zeros follow the end."""
    line = np.zeros(len(text) + 8, np.uint64)
    line[: len(text)] = text
    out = np.zeros(len(text), np.uint64)
    for k in range(8):
        out |= line[k : k + len(text)] << np.uint64(56 - 8 * k)
    return out


def suffix_ranks(words: np.ndarray) -> np.ndarray:
    """Rank of every suffix, after Larsson and Sadakane.

    ``words`` are the packed bytes.  Suffixes start sorted by eight bytes.  A group of equal ones has the
    number of its last place; only groups of several are sorted again, by the ranks of the suffixes that
    stand as far behind as is sorted so far, which doubles that depth each time.
    """
    n = len(words)
    order = np.argsort(words)
    rank = np.empty(n, np.int64)
    _number(order, words[order], rank)
    sorted_to = 8
    places, group = _unsorted(order, rank)
    while len(places):
        behind = places + sorted_to
        # Of suffixes that end within the sorted depth the shorter comes first.
        second = np.where(behind < n, rank[np.minimum(behind, n - 1)], n - 1 - behind)
        # Places stay group by group, so a group's numbers are its own whatever the order within.
        resorted = np.argsort(group * (2 * n) + (second + n))
        places, second, group = places[resorted], second[resorted], group[resorted]
        size_before = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1])
        counts = np.diff(np.concatenate([size_before, [len(group)]]))
        first = np.repeat(group[size_before] - counts + 1, counts)
        at = first + np.arange(len(group)) - np.repeat(size_before, counts)
        new = np.ones(len(group), bool)
        new[1:] = (np.diff(group) != 0) | (np.diff(second) != 0)
        starts = np.flatnonzero(new)
        lengths = np.diff(np.concatenate([starts, [len(group)]]))
        last = np.repeat(at[starts] + lengths - 1, lengths)
        rank[places] = last
        more = np.repeat(lengths > 1, lengths)
        places, group = places[more], last[more]
        sorted_to *= 2
    return rank


def _number(order: np.ndarray, keys: np.ndarray, rank: np.ndarray) -> None:
    new = np.ones(len(order), bool)
    new[1:] = keys[1:] != keys[:-1]
    starts = np.flatnonzero(new)
    lengths = np.diff(np.concatenate([starts, [len(order)]]))
    rank[order] = np.repeat(starts + lengths - 1, lengths)


def _unsorted(order: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    group = rank[order]
    counts = np.bincount(group, minlength=len(rank)) if len(group) else np.zeros(0, int)
    more = counts[group] > 1
    return order[more], group[more]


def common_prefixes(
    words: np.ndarray, before: np.ndarray, starts: np.ndarray, counts: np.ndarray, most: int
) -> np.ndarray:
    """Common prefix, up to ``most`` bytes, of a suffix and the one ``before`` it in suffix order, after Kasai.

    ``before`` holds that other suffix's place for every place, or -1.  A run of places is gone through
    from left to right: the next place shares at least one byte less than the last did, if the place next to the other
    suffix is in order too.  All runs (from ``starts``, of ``counts`` places) advance side by side, each by eight bytes
    or to its next place.
    """
    n = len(words)
    out = np.zeros(n, np.int64)
    at, end = starts[counts > 0].copy(), (starts + counts)[counts > 0]
    known = np.zeros(len(at), np.int64)
    while len(at):
        other = before[at]
        a, b = at + known, other + known
        open_ = (other >= 0) & (known < most) & (a < n) & (b < n)
        differ = words[np.minimum(a, n - 1)] ^ words[np.minimum(b, n - 1)]
        same = open_ & (differ == 0)
        # Bytes that agree before the first that does not.
        known += np.where(same, 8, np.where(open_, 7 - np.searchsorted(_BYTE_STEPS, differ, "right"), 0))
        done = np.flatnonzero(~same)
        here, there = at[done], other[done]
        found = np.minimum(known[done], np.minimum(most, n - np.maximum(here, there)))
        out[here] = found = np.where(there >= 0, found, 0)
        known[done] = np.where(before[np.minimum(there + 1, n - 1)] > NO_SUFFIX, np.maximum(found - 1, 0), 0)
        at[done] += 1
        if (at == end).any():
            more = at < end
            at, end, known = at[more], end[more], known[more]
    return out
