"""Suffix arrays by linear grouping: order groups of Lyndon prefixes first, then emit each group's order.

No suffix is ever renamed and no reduced string is sorted again. The first phase holds the suffixes
in groups of equal known prefixes, highest group first; taking a group tells each suffix before it
that is still lower (its previous-smaller position) how its Lyndon prefix goes on, and moves that
suffix up within its group. The second phase fills the array from the left: a placed suffix places
the suffixes whose next-smaller suffix it is, found along the same previous-smaller pointers.
"""

from __future__ import annotations


def suffix_array(text: list[int]) -> list[int]:
    """Positions of the suffixes of ``text`` (integers, any alphabet) in ascending order."""
    n = len(text)
    if not n:
        return []
    members: list[list[int]] = []
    group = [0] * n
    first: dict[int, int] = {}
    for i, x in enumerate(text):
        if x not in first:
            first[x] = len(members)
            members.append([])
        g = group[i] = first[x]
        members[g].append(i)
    ascending = [first[x] for x in sorted(first)]
    # groups as a list linked from higher to lower ones; -1 ends it
    lower, upper = [-1] * len(members), [-1] * len(members)
    for a, b in zip(ascending, ascending[1:]):
        lower[b], upper[a] = a, b
    # positions whose group has not been taken, as a linked list; n stands behind the end
    left = list(range(-1, n))
    right = list(range(1, n + 2))
    previous = [-1] * n

    g = ascending[-1]
    while g >= 0:
        taken = [i for i in members[g] if group[i] == g]
        taken.sort()
        members[g] = taken
        told: dict[int, int] = {}
        for i in taken:
            j, k = left[i], right[i]
            previous[i] = j
            left[k] = j
            if j >= 0:
                right[j] = k
                told[j] = told.get(j, 0) + 1
        if told:
            # more copies of the taken prefix behind a position put it higher
            moves: dict[tuple[int, int], list[int]] = {}
            for j, times in told.items():
                moves.setdefault((-times, group[j]), []).append(j)
            for key in sorted(moves) if len(moves) > 1 else moves:
                old, own = key[1], moves[key]
                new = len(members)
                members.append(own)
                up = upper[old]
                lower.append(old)
                upper.append(up)
                upper[old] = new
                if up >= 0:
                    lower[up] = new
                for j in own:
                    group[j] = new
        bottom, g = g, lower[g]

    place = [0] * len(members)
    at, g = 0, bottom
    while g >= 0:
        place[g] = at
        at += len(members[g])
        g = upper[g]
    order, placed = [-1] * n, bytearray(n)
    j = n - 1
    for i in range(-1, n):
        if i >= 0:
            j = order[i] - 1
        while j >= 0 and not placed[j]:
            placed[j] = 1
            g = group[j]
            order[place[g]] = j
            place[g] += 1
            j = previous[j]
    return order
