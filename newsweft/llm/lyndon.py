"""Suffix order of many short texts by Lyndon grouping, without sorting a renamed text.

The suffixes are grouped by their longest prefix that is a Lyndon word. Groups begin as single units and are
gone through from the highest to the lowest. When a group is reached its suffixes have their final prefix; each
looks up the nearest place before it whose suffix is smaller. That place's own prefix ends just where the group's
begins, so it grows by it, and moves to a new group right above its old one. Then the order is emitted from the
ends of the texts: a suffix follows, in its group, the order of the suffix that begins where its prefix ends.

Each text ends with a mark below all units, so no prefix reaches over two texts.
"""

from __future__ import annotations

import numpy as np


def lyndon_groups(units: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Group of each place, places of its prefix, and the groups from the lowest to the highest.

    Zero is the mark that ends a text; its places are a group of their own, number 0, the lowest.
    """
    n = len(units)
    alphabet = sorted(set(units) | {0})
    number = {u: k for k, u in enumerate(alphabet)}
    group = [number[u] for u in units]
    members: list[list[int]] = [[] for _ in alphabet]
    for place, g in enumerate(group):
        members[g].append(place)
    count = [len(m) for m in members]
    below = list(range(-1, len(alphabet) - 1))
    above = [*range(1, len(alphabet)), -1]
    size = [1] * n
    smaller = [-1] * n
    done = bytearray(n)
    g = len(alphabet) - 1
    while g > 0:
        own = [p for p in members[g] if group[p] == g]
        members[g] = own
        follows: dict[int, int] = {}
        for p in own:
            j = p - 1
            while j >= 0 and (done[j] or group[j] == g):
                j = smaller[j]
            smaller[p] = j
            if j >= 0 and group[j]:
                follows[j] = follows.get(j, 0) + 1
        if own:
            grown = size[own[0]]
            for p in own:
                done[p] = 1
            if len(follows) == 1:
                (p, k), = follows.items()
                size[p] += grown * k
                old = group[p]
                if count[old] > 1:
                    count[old] -= 1
                    new = len(members)
                    members.append([p])
                    count.append(1)
                    top = above[old]
                    above.append(top)
                    below.append(old)
                    above[old] = new
                    below[top] = new
                    group[p] = new
            elif follows:
                parted: dict[tuple[int, int], list[int]] = {}
                for p, k in follows.items():
                    size[p] += grown * k
                    parted.setdefault((group[p], k), []).append(p)
                # More copies of the prefix in a row stand higher: placed last to stay nearest to the group's top.
                for old, k in sorted(parted, reverse=True):
                    moved = parted[old, k]
                    if count[old] == len(moved):
                        continue
                    count[old] -= len(moved)
                    new = len(members)
                    members.append(moved)
                    count.append(len(moved))
                    top = above[old]
                    above.append(top)
                    below.append(old)
                    above[old] = new
                    if top >= 0:
                        below[top] = new
                    for p in moved:
                        group[p] = new
        g = below[g]
    order, g = [], 0
    while g >= 0:
        order.append(g)
        g = above[g]
    return group, size, order


def suffix_array(units: list[int]) -> list[int]:
    """Places of all suffixes in ascending order; the end marks come first, in the order of the texts."""
    n = len(units)
    if not n:
        return []
    group, size, order = lyndon_groups(units)
    slot = [0] * (max(order) + 1)
    held = np.bincount(np.asarray(group), minlength=len(slot))
    at = 0
    for g in order:
        slot[g] = at
        at += int(held[g])
    ends = np.arange(n) + np.asarray(size)
    marks = np.asarray(units) == 0
    ends[marks] = n
    by_end = np.argsort(ends, kind="stable")
    cuts = np.searchsorted(ends[by_end], np.arange(n + 1)).tolist()
    by_end = by_end.tolist()
    out = [0] * n
    for place in np.nonzero(marks)[0].tolist():
        out[slot[0]] = place
        slot[0] += 1
    for k in range(n):
        place = out[k]
        for p in by_end[cuts[place] : cuts[place + 1]]:
            g = group[p]
            out[slot[g]] = p
            slot[g] += 1
    return out
