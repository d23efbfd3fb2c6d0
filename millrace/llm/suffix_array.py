"""Suffix arrays by grouping."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def suffix_array(text: Sequence[int]) -> list[int]:
    """The suffixes of ``text`` in order. Its last symbol must be smaller than all others and occur once.

    First the suffixes are grouped by their longest Lyndon prefixes. They start in groups by first symbol. Groups are
    taken in descending order; each member points to the nearest earlier suffix of a lower group, and the suffixes
    pointed at leave their groups for new ones right above, those with more pointers higher: their Lyndon prefixes have
    grown by the prefix of the group as often. A group is then final, and is never named or looked at again. Then one
    pass over the suffix array puts the order of each group out: a suffix is preceded by the chain of its pointers, each
    the next of its group.
    """
    n = len(text)
    first = np.asarray(text)
    order = np.argsort(first, kind="stable")
    ranked = first[order]
    begins = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if n else np.zeros(0, np.int64)
    start_of = np.repeat(begins, np.diff(np.append(begins, n)))
    group = np.empty(n, np.int64)
    group[order] = start_of  # a group's number is where it begins in ``members``
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    members, group, place = order.tolist(), group.tolist(), place.tolist()
    size = [0] * n
    for a, b in zip(begins.tolist(), np.append(begins[1:], n).tolist(), strict=True):
        size[a] = b - a
    before = [-1] * n

    stop = n
    while stop > 0:
        g = group[members[stop - 1]]
        own = members[g:stop]
        if stop - g > 1:
            own.sort()
        times: dict[int, int] = {}
        for i in own:
            j = i - 1
            while j >= 0 and group[j] >= g:
                j = before[j]
            before[i] = j
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        stop = g
        if not times:
            continue
        if len(own) == 1:
            levels = [list(times)]
        else:
            most = max(times.values())
            levels = [list(times)] if most == 1 else [[j for j, t in times.items() if t == level] for level in range(most, 0, -1)]
        for level in levels:
            moved: dict[int, int] = {}
            for j in level:  # to the end of the old group, which gets shorter
                old = group[j]
                n_moved = moved.get(old, 0)
                last = old + size[old] - 1 - n_moved
                here, other = place[j], members[last]
                members[here], members[last] = other, j
                place[other], place[j] = here, last
                moved[old] = n_moved + 1
            for old, m in moved.items():
                size[old] -= m
                new = old + size[old]
                size[new] = m
                if new != old:
                    for at in range(new, new + m):
                        group[members[at]] = new

    out = [-1] * n
    filled = [0] * n
    done = [False] * n
    if n:
        out[0] = n - 1
        done[n - 1] = True
        filled[group[n - 1]] = 1
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            out[g + filled[g]] = j
            filled[g] += 1
            done[j] = True
            j = before[j]
    return out
