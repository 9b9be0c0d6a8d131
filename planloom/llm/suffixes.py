"""Suffix arrays in numpy: Larsson-Sadakane refinement and common prefixes."""

from __future__ import annotations

import numpy as np


def refine(
    keys: np.ndarray, first: int, until: int | None = None, levels: list | None = None, room: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and ranks by Larsson-Sadakane doubling.

    `keys` order the suffixes by their first `first` symbols. A group of suffixes that are equal so
    far has as its number its first place in the array; each round sorts only the groups that are
    not yet single, by the group number `h` symbols on, and doubles h, until all are single or h
    is `until` (the last round goes just so far). `levels` collects (h, numbers) before each round.

    With `room`, the symbols from each place to its block's end, a suffix is refined no further than
    its room: then the numbers tell those apart by h symbols that have room for h, and no others.
    """
    n = len(keys)
    sa = np.argsort(keys, kind="stable")
    ordered = keys[sa]
    new = np.ones(n, bool)
    new[1:] = ordered[1:] != ordered[:-1]
    start = np.flatnonzero(new)
    number = np.repeat(start, np.diff(np.append(start, n)))
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[sa] = number
    h = first
    size = np.repeat(np.diff(np.append(start, n)), np.diff(np.append(start, n)))
    places = np.flatnonzero(size > 1)
    while True:
        if levels is not None:
            levels.append((h, rank[:-1].copy()))
        if not len(places) or (until is not None and h >= until):
            return sa, rank[:-1]
        step = h if until is None else min(h, until - h)
        at = sa[places]
        if room is not None:
            wide = room[at] >= h + step
            places, at = places[wide], at[wide]
        pair = rank[at] * (n + 1) + rank[np.minimum(at + step, n)] + 1
        order = np.argsort(pair, kind="stable")
        at, pair = at[order], pair[order]
        sa[places] = at
        new = np.ones(len(at), bool)
        new[1:] = pair[1:] != pair[:-1]
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(at)))
        rank[at] = np.repeat(places[start], size)
        places = places[np.repeat(size, size) > 1]
        h += step


def common_prefixes(sa: np.ndarray, levels: list) -> np.ndarray:
    """Of each entry with the one before it: the common prefix length, found by descending through
    the doubling levels (equal numbers at level h mean h equal symbols). For keys of single symbols."""
    n = len(sa)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    i, j = sa[:-1].copy(), sa[1:].copy()
    got = out[1:]
    for h, rank in reversed(levels):
        ok = (i + h <= n) & (j + h <= n)
        ok[ok] = rank[i[ok]] == rank[j[ok]]
        got[ok] += h
        i[ok] += h
        j[ok] += h
    return out
