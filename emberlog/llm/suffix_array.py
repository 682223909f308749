"""Suffix arrays by linear grouping.

First, suffixes are grouped by their Lyndon prefixes. Groups are taken from the highest to the
lowest; a pointer leads from each suffix to the nearest earlier one in a lower group, over the
pointers of suffixes already done. The suffix it leads to is followed by this group's
prefix, once or several times in a row, and so moves up to a group of its own behind those that
aren't. Then the suffixes are put in order within their groups from the lowest on, each followed
by the chain of earlier suffixes that lead to it. No suffix is ever renamed or sorted again.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Begins of all suffixes of ``text`` (whole numbers from 0 on) in ascending order; a prefix comes first."""
    n = len(text) + 1
    symbols = np.zeros(n, dtype=np.int64)
    symbols[:-1] = np.asarray(text, dtype=np.int64) + 1
    order = np.argsort(symbols, kind="stable")
    ranked = symbols[order]
    begins = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    sizes = np.diff(np.append(begins, n))
    group_of = np.empty(n, dtype=np.int64)
    group_of[order] = np.repeat(begins, sizes)
    place_of = np.empty(n, dtype=np.int64)
    place_of[order] = np.arange(n)

    ranks, group, place = order.tolist(), group_of.tolist(), place_of.tolist()
    last = [0] * n  # of each group, by its first place
    for a, size in zip(begins.tolist(), sizes.tolist()):
        last[a] = a + size - 1
    earlier = [-1] * n

    end = n - 1
    while end > 0:
        first = group[ranks[end]]
        if first == end:
            # most groups hold one suffix
            s = ranks[end]
            p = s - 1
            while p >= 0 and group[p] > first:
                p = earlier[p]
            earlier[s] = p
            end -= 1
            if p >= 0:
                low = group[p]
                high = last[low]
                if high != low:
                    at = place[p]
                    if at != high:
                        other = ranks[high]
                        ranks[at], place[other] = other, at
                        ranks[high], place[p] = p, high
                    last[low] = high - 1
                    group[p], last[high] = high, high
            continue
        repeats: dict[int, int] = {}
        heads = []
        for s in ranks[first : end + 1]:
            p = s - 1
            while p >= 0 and group[p] > first:
                p = earlier[p]
            if p >= 0 and group[p] == first:
                repeats[p] = s
            else:
                earlier[s] = p
                heads.append((p, s))
        end = first - 1
        if repeats:
            # how often the group's prefix follows in a row; more of them is higher
            by_count: dict[int, list[int]] = {}
            for p, s in heads:
                count = 1
                while s in repeats:
                    s = repeats[s]
                    earlier[s] = p
                    count += 1
                if p >= 0:
                    by_count.setdefault(count, []).append(p)
            levels = [by_count[count] for count in sorted(by_count, reverse=True)]
        else:
            levels = [[p for p, _ in heads if p >= 0]]
        for moving in levels:
            touched: dict[int, int] = {}
            for p in moving:
                low = group[p]
                if low not in touched:
                    touched[low] = last[low]
                high = last[low]
                at = place[p]
                if at != high:
                    other = ranks[high]
                    ranks[at], place[other] = other, at
                    ranks[high], place[p] = p, high
                last[low] = high - 1
            for low, high in touched.items():
                start = last[low] + 1
                if start == low:
                    last[low] = high  # the whole group moved on
                    continue
                last[start] = high
                for p in ranks[start : high + 1]:
                    group[p] = start

    front = list(range(n))  # next free place of each group, by its first place
    done = bytearray(n)
    done[n - 1] = 1
    ranks[0] = n - 1
    for i in range(n):
        s = ranks[i] - 1
        while s >= 0 and not done[s]:
            done[s] = 1
            g = group[s]
            at = front[g]
            ranks[at] = s
            front[g] = at + 1
            s = earlier[s]
    return np.array(ranks[1:], dtype=np.int64)
