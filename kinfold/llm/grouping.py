"""Suffix arrays of many short texts at once by linear grouping.

Suffixes are grouped by their Lyndon prefixes. Groups are taken from the highest to the lowest; for
each of a group's suffixes a pointer leads to the nearest suffix to its left in a lower group, and
the suffixes so pointed at move into a new group just above their old one, further up the more
pointers reach them. In the end each group shares its Lyndon prefix, and the order within a group is
that of the suffixes that follow the prefix: going up through the suffix array, each suffix hands
out the places of those whose prefix ends where it begins, along the same pointers. Nothing is
renamed or sorted again.

The texts are worked through side by side, one group of each per step, so that numpy carries the
loop; the steps are as many as the longest text has suffixes.
"""

from __future__ import annotations

import numpy as np


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    return np.arange(ends[-1]) - np.repeat(ends - sizes - starts, sizes)


def suffix_arrays(symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Suffix arrays of the texts symbols[offsets[b]:offsets[b+1]], one after the other, as positions
    in ``symbols``. Each text must end with a symbol that is smaller than all its others."""
    n, lengths = len(symbols), np.diff(offsets)
    block = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    low = offsets[block].astype(np.int32)
    order = np.lexsort((symbols, block)).astype(np.int32)
    new = np.append(True, (symbols[order][1:] != symbols[order][:-1]) | (block[order][1:] != block[order][:-1])) if n else np.zeros(0, bool)
    begins = np.flatnonzero(new)
    group = np.empty(n, np.int32)  # of each suffix: where its group begins in the order
    group[order] = np.repeat(begins, np.diff(np.append(begins, n)))
    size = np.zeros(n + 1, np.int32)
    size[begins] = np.diff(np.append(begins, n))
    place = np.empty(n, np.int32)
    place[order] = np.arange(n)
    left = np.arange(-1, n - 1, dtype=np.int32)  # nearest suffix to the left in a lower group, once the group was taken
    moved = np.zeros(n, bool)

    del block, new
    top = offsets[1:].copy()
    open_ = np.flatnonzero(top > offsets[:-1])
    while len(open_):
        at = group[order[top[open_] - 1]]
        suffixes = order[_ranges(at, top[open_] - at)]
        base = group[suffixes]
        floor = low[suffixes]
        todo = np.arange(len(suffixes))
        while len(todo):
            p = left[suffixes[todo]]
            todo = todo[(p >= floor[todo]) & (group[p] >= base[todo])]
            left[suffixes[todo]] = left[left[suffixes[todo]]]
        top[open_] = at
        open_ = open_[at > offsets[open_]]
        p = left[suffixes]
        p = p[p >= floor]
        if not len(p):
            continue
        p, k = np.unique(p, return_counts=True)
        old = group[p]
        if n < 1 << 21:  # group, count and place fit one number, which sorts faster
            packed = np.sort(old.astype(np.int64) << 42 | k << 21 | p)
            old, k, p = packed >> 42, packed >> 21 & 0x1FFFFF, packed & 0x1FFFFF
        else:
            by = np.lexsort((k, old))
            p, k, old = p[by], k[by], old[by]
        run = np.flatnonzero(np.append(True, old[1:] != old[:-1]))
        many = np.diff(np.append(run, len(p)))
        first = old[run] + size[old[run]] - many  # where what moves begins in its old group
        target = _ranges(first, many)
        # Swap: what stays but stands where others move to takes the places that they leave.
        moved[p] = True
        standing = order[target]
        stay = standing[~moved[standing]]
        leave = place[p][place[p] < np.repeat(first, many)]
        moved[p] = False
        order[leave] = stay
        place[stay] = leave
        order[target] = p
        place[p] = target
        part = np.flatnonzero(np.append(True, (old[1:] != old[:-1]) | (k[1:] != k[:-1])))
        counts = np.diff(np.append(part, len(p)))
        size[old[run]] -= many
        size[target[part]] = counts
        group[p] = np.repeat(target[part], counts)

    out = np.full(n, -1, np.int32)
    free = np.arange(n + 1, dtype=np.int32)  # next place of each group
    placed = np.zeros(n, bool)
    full = np.flatnonzero(lengths > 0)
    out[offsets[full]] = offsets[full + 1] - 1
    placed[offsets[full + 1] - 1] = True
    full = full[np.argsort(-lengths[full], kind="stable")]
    longest_first = lengths[full]
    begin = offsets[full]
    for step in range(int(longest_first[0]) if len(full) else 0):
        live = int(np.searchsorted(-longest_first, -step, "left"))
        b = begin[:live]
        j = out[b + step] - 1
        while True:
            ok = j >= b
            ok[ok] = ~placed[j[ok]]
            if not ok.any():
                break
            j, b = j[ok], b[ok]
            slot = free[group[j]]
            out[slot] = j
            placed[j] = True
            free[group[j]] = slot + 1
            j = left[j]
    return out
