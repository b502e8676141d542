"""Suffix sorting by groups of Lyndon prefixes, without recursion or renaming.

Each suffix is looked at a constant number of times; members of a group are sorted by place and by burden instead of
dealt into buckets, and first symbols by comparison, so the time is linear but for these sorts.

Phase 1 puts suffixes into groups that share their longest Lyndon prefix.  It starts from groups of equal first
symbols and takes groups in descending order.  Each suffix of the group at hand hangs on its previous smaller
suffix: the nearest position before it whose group is lower.  The Lyndon prefix of such a position goes on with
that of the group, so positions with more suffixes of the group hanging on them move to higher groups just
behind their old one.  Phase 2 passes through the suffixes in ascending order: every suffix whose Lyndon prefix
ends where the current suffix begins takes the next free place of its group.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes of an integer string; its last symbol must be smaller than all others."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    first = np.argsort(text, kind="stable")
    ordered = text[first]
    starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    sizes = np.diff(np.concatenate((starts, [n])))
    group_of = np.empty(n, np.int64)
    group_of[first] = np.repeat(starts, sizes)
    rank = np.empty(n, np.int64)
    rank[first] = np.arange(n)
    size_list = np.zeros(n, np.int64)
    size_list[starts] = sizes
    group, place, at, size = group_of.tolist(), rank.tolist(), first.tolist(), size_list.tolist()
    smaller = _grouped(group, place, at, size)
    return np.array(_emitted(group, smaller), np.int64)


def _grouped(group: list[int], place: list[int], at: list[int], size: list[int]) -> list[int]:
    """Refines the groups in place; returns the previous smaller suffix of each position (-1: none)."""
    smaller = [-1] * len(at)
    end = len(at)
    while end > 0:
        low = group[at[end - 1]]
        # in text order, so that pointers of earlier members are known
        members = at[low:end]
        members.sort()
        hanging: dict[int, int] = {}
        for s in members:
            j = s - 1
            while j >= 0 and group[j] >= low:
                j = smaller[j]
            smaller[s] = j
            if j >= 0:
                hanging[j] = hanging.get(j, 0) + 1
        if hanging:
            by_group: dict[int, list[int]] = {}
            for p in hanging:
                g = group[p]
                if g in by_group:
                    by_group[g].append(p)
                else:
                    by_group[g] = [p]
            for g, moved in by_group.items():
                if len(moved) > 1:
                    moved.sort(key=hanging.__getitem__)
                stop = g + size[g]
                begin = stop - len(moved)
                size[g] -= len(moved)
                # swap the moved ones behind those that stay, the most burdened last
                to = stop
                for p in reversed(moved):
                    to -= 1
                    here, other = place[p], at[to]
                    at[here], at[to] = other, p
                    place[other], place[p] = here, to
                new, last = begin, hanging[moved[0]]
                for k, p in enumerate(moved, begin):
                    if hanging[p] != last:
                        size[new] = k - new
                        new, last = k, hanging[p]
                    group[p] = new
                size[new] = stop - new
        end = low
    return smaller


def _emitted(group: list[int], smaller: list[int]) -> list[int]:
    n = len(group)
    out, free, placed = [0] * n, list(range(n)), [False] * n
    out[0] = n - 1
    placed[n - 1] = True
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = True
            j = smaller[j]
    return out


def repeated_windows(strings: list[np.ndarray], length: int) -> list[np.ndarray]:
    """For each string, which of its windows of ``length`` symbols also start anywhere else.

    The strings are sorted as one, each closed by a symbol of its own; equal windows are neighbours in suffix
    order.  Symbols must be non-negative.
    """
    m = len(strings)
    if not m:
        return []
    lengths = np.fromiter(map(len, strings), np.int64, m)
    bounds = np.concatenate(([0], np.cumsum(lengths + 1)))
    text = np.empty(bounds[-1], np.int64)
    for k, s in enumerate(strings):
        text[bounds[k] : bounds[k + 1] - 1] = s + m
        text[bounds[k + 1] - 1] = m - 1 - k
    order = suffix_array(text)
    owner = np.searchsorted(bounds, order, side="right") - 1
    whole = order + length <= bounds[owner + 1] - 1
    begins = order[whole]
    found = np.zeros(len(text), bool)
    same = np.zeros(max(len(begins) - 1, 0), bool)
    steps = np.arange(length)
    for at in range(0, len(same), 1 << 14):
        a, b = begins[at : at + (1 << 14)], begins[at + 1 : at + 1 + (1 << 14)]
        a = a[: len(b)]
        same[at : at + len(b)] = (text[a[:, None] + steps] == text[b[:, None] + steps]).all(1)
    found[begins[:-1][same]] = True
    found[begins[1:][same]] = True
    return [found[bounds[k] : max(bounds[k + 1] - length, bounds[k])] for k in range(m)]
