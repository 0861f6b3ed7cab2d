"""Suffix sorting by linear grouping.

First phase: suffixes are held in groups by a prefix that grows to the suffix's longest Lyndon
prefix. Groups are taken in descending order. Of each suffix of the group at hand, the previous
smaller position is the nearest one to the left that isn't taken yet (pointers over taken positions,
halved as they are followed); its prefix grows by that of the group, once for each of the group's suffixes
that point to it, and it moves to a new group just above its old one. Second phase: suffixes are
emitted in ascending order; each one emitted lets every suffix whose next smaller suffix it is take the
next place of its group. No ranks are renamed and nothing is sorted again.

The text: strings of symbols, each closed by an ending that is smaller than all symbols and unlike the other endings.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray, strings: int) -> np.ndarray:
    """text: strings joined, symbols of at least ``strings``; the k-th ending is the symbol k, k < strings."""
    n = len(text)
    symbols = text.tolist()
    groups: list[list[int]] = []  # the members that came to a group; those that left since have another number
    size: list[int] = []  # the length of a group's prefix
    above: list[int] = []  # the next greater group
    below: list[int] = []
    of = [0] * n
    first = {}
    for c in sorted(set(symbols)):
        first[c] = len(groups)
        groups.append([])
        size.append(1)
        below.append(len(groups) - 2)
        above.append(len(groups))
    above[-1] = -1
    for i, c in enumerate(symbols):
        g = first[c]
        of[i] = g
        groups[g].append(i)
    left = list(range(n))  # a taken position points to the left, one not taken to itself
    last_ending = first[strings - 1]
    g = len(groups) - 1
    while g != last_ending:
        members = [i for i in groups[g] if of[i] == g]
        groups[g] = members
        if members:
            for i in members:
                left[i] = i - 1
            points: dict[int, int] = {}
            for i in members:
                p = i - 1
                while (q := left[p]) != p:
                    left[p] = q = left[q]
                    p = q
                if p in points:
                    points[p] += 1
                else:
                    points[p] = 1
                left[i] = p
            moved: dict[tuple[int, int], list[int]] = {}
            for p, times in points.items():
                h = of[p]
                if h > last_ending:
                    if (h, times) in moved:
                        moved[h, times].append(p)
                    else:
                        moved[h, times] = [p]
            grown = size[g]
            for h, times in sorted(moved, key=lambda x: -x[1]) if len(moved) > 1 else moved:
                new = len(groups)
                some = moved[h, times]
                groups.append(some)
                size.append(size[h] + times * grown)
                up = above[h]
                above.append(up)
                below.append(h)
                below[up] = new  # there is one: the group at hand is greater
                above[h] = new
                for p in some:
                    of[p] = new
        g = below[g]
    # the groups' first places, in ascending order, and each suffix's next smaller one
    place = [0] * len(groups)
    at, g = 0, first[0]
    while g != -1:
        place[g] = at
        at += sum(of[i] == g for i in groups[g]) if g <= last_ending else len(groups[g])
        g = above[g]
    number = np.array(of)
    smaller = np.arange(n) + np.array(size)[number]
    ending = text < strings
    smaller[ending] = n
    order = np.argsort(smaller, kind="stable")
    begins = np.searchsorted(smaller[order], np.arange(n + 2)).tolist()
    waiting = order.tolist()
    out = [0] * n
    for k, i in enumerate(np.nonzero(ending)[0].tolist()):
        out[k] = i
    for at in range(n):
        i = out[at]
        for x in range(begins[i], begins[i + 1]):
            j = waiting[x]
            h = of[j]
            out[place[h]] = j
            place[h] += 1
    return np.array(out)
