"""Suffix arrays by linear grouping.

Suffixes are grouped by their Lyndon prefix: the part up to the next smaller
suffix. Phase 1 takes groups from the highest down; each member points to the
nearest earlier suffix of a lower group, and suffixes pointed to move, by how
often, into new groups right above their old ones. Phase 2 reads the final
order off the groups from the lowest up: a suffix settles the order of those
whose Lyndon prefix ends where it starts. No group is ever renamed, and
nothing recurses.
"""

from __future__ import annotations


def suffix_array(s: list[int]) -> list[int]:
    """The start positions of the suffixes of ``s`` in lexicographic order.

    Symbols are positive integers; a shorter suffix precedes its extensions.
    """
    n = len(s) + 1
    s = [*s, 0]  # the end is the smallest symbol
    order = sorted(range(n), key=s.__getitem__)
    place, group, size = [0] * n, [0] * n, [0] * n
    start, last = 0, -1
    for k, i in enumerate(order):
        if s[i] != last:
            start, last = k, s[i]
        place[i] = k
        group[i] = start
        size[start] += 1
    before = list(range(-1, n - 1))

    top = n - 1
    while top >= 0:
        low = group[order[top]]
        often: dict[int, int] = {}
        for i in order[low : top + 1]:
            p = before[i]
            while p >= 0 and group[p] >= low:
                p = before[p]
            before[i] = p
            if p >= 0:
                often[p] = often.get(p, 0) + 1
        split: dict[int, list[int]] = {}
        for p in often:
            g = group[p]
            if size[g] > 1:
                if g in split:
                    split[g].append(p)
                else:
                    split[g] = [p]
        for g, moved in split.items():
            if len(moved) > 1:
                moved.sort(key=often.__getitem__)
            elif size[g] == 1:
                continue
            end = g + size[g]
            k = len(moved)
            while k:
                # Suffixes pointed to equally often form one new group, the most often on top.
                times, first = often[moved[k - 1]], k - 1
                while first and often[moved[first - 1]] == times:
                    first -= 1
                here = end - (k - first)
                for p in moved[first:k]:
                    end -= 1
                    other, at = order[end], place[p]
                    order[at], order[end] = other, p
                    place[other], place[p] = at, end
                    group[p] = here
                size[here] = k - first
                k = first
            if end > g:
                size[g] = end - g
        top = low - 1

    done = [False] * n
    front = list(range(n))  # the next free place of the group that starts here
    out = [-1] * n
    out[0] = n - 1
    done[n - 1] = True
    for k in range(n):
        p = out[k] - 1
        while p >= 0 and not done[p]:
            g = group[p]
            out[front[g]] = p
            front[g] += 1
            done[p] = True
            p = before[p]
    return out[1:]


def lcp_array(s: list[int], order: list[int], end: int = -1) -> list[int]:
    """``lcp[k]``: symbols that suffixes ``order[k - 1]`` and ``order[k]`` share; ``end`` equals nothing."""
    n = len(s)
    rank = [0] * n
    for k, i in enumerate(order):
        rank[i] = k
    lcp, h = [0] * n, 0
    for i in range(n):
        k = rank[i]
        if k:
            j = order[k - 1]
            while i + h < n and j + h < n and s[i + h] == s[j + h] != end:
                h += 1
            lcp[k] = h
            if h:
                h -= 1
        else:
            h = 0
    return lcp
