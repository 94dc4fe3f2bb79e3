"""Suffix arrays by linear grouping.

First the suffixes are grouped by their Lyndon prefix: starting from groups of one first symbol,
groups are processed in descending order, and every suffix that is the nearest smaller one to the
left of ``k`` members of the current group has its own prefix extended by the group's, ``k`` times,
which splits it off into a new group just above its old one. Then, from the smallest suffix on,
each suffix in order puts the suffixes that end where it begins (along the previous-smaller
pointers) at the next free place of their groups. No ranks are renamed and nothing recurses.
"""

from __future__ import annotations


def suffix_array(text: list[int]) -> list[int]:
    """Order of the suffixes of ``text``; its last symbol must be smaller than all others."""
    n = len(text)
    first: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        first.setdefault(c, []).append(i)
    # groups in a doubly linked list; members that have moved on are skipped when read
    members = [first[c] for c in sorted(first)]
    count = len(members)
    above = [*range(1, count), -1]
    below = [*range(-1, count - 1)]
    number = {c: g for g, c in enumerate(sorted(first))}
    group = [number[c] for c in text]
    smaller = [-1] * n  # previous-smaller pointers, set when a suffix's group is processed
    left = list(range(-1, n - 1))  # of a processed suffix: a place to its left, skipping processed ones
    done = [False] * n

    def split(own: list[int]) -> None:
        """Move suffixes (all extended equally often) out of their groups into new ones just above."""
        new: dict[int, int] = {}
        for p in own:
            old = group[p]
            fresh = new.get(old)
            if fresh is None:
                new[old] = fresh = len(members)
                members.append([])
                up = above[old]
                above.append(up)
                below.append(old)
                below[up] = above[old] = fresh
            members[fresh].append(p)
            group[p] = fresh

    g = count - 1
    while g >= 0:
        own = members[g]
        if g < count or len(own) > 1:
            own = [i for i in own if group[i] == g]
            members[g] = own
        elif group[own[0]] != g:
            own = members[g] = []
        if len(own) == 1:  # most groups hold one suffix, which needs no counting
            i = own[0]
            done[i] = True
            p = i - 1
            while p >= 0 and done[p]:
                p = left[p]
            smaller[i] = left[i] = p
            if p >= 0:
                old = group[p]
                fresh = len(members)
                members.append([p])
                up = above[old]
                above.append(up)
                below.append(old)
                below[up] = above[old] = group[p] = fresh
        elif own:
            for i in own:
                done[i] = True
            times: dict[int, int] = {}
            for i in own:
                p = i - 1
                while p >= 0 and done[p]:
                    p = left[p]
                smaller[i] = left[i] = p
                if p >= 0:
                    times[p] = times.get(p, 0) + 1
            if times:
                most = max(times.values())
                if most == 1:
                    split(list(times))
                else:
                    by: dict[int, list[int]] = {}
                    for p, k in times.items():
                        by.setdefault(k, []).append(p)
                    for k in sorted(by, reverse=True):
                        split(by[k])
        g = below[g]
    # places of the groups, smallest first
    bottom = group[n - 1]
    while below[bottom] >= 0:
        bottom = below[bottom]
    place = [0] * len(members)
    at, g = 0, bottom
    while g >= 0:
        place[g] = at
        at += len(members[g])
        g = above[g]
    order = [-1] * n
    order[0] = n - 1
    group[n - 1] = -1  # of a suffix that has its place
    for i in range(n):
        p = order[i] - 1
        while p >= 0:
            g = group[p]
            if g < 0:
                break
            at = place[g]
            order[at] = p
            place[g] = at + 1
            group[p] = -1
            p = smaller[p]
    return order
