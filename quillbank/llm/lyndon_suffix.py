"""Suffix arrays by linear grouping, as whole-array steps in numpy.

Phase one puts suffixes that start with the same longest Lyndon word into one group and
orders the groups. It goes through the suffixes in descending order. A suffix's group is
decided by its first character and by the groups of its *children*, the suffixes whose
previous smaller suffix it is, from left to right: its Lyndon word is that character
followed by theirs. Groups are ranges of places of the suffix array, so splitting one
leaves all others alone. The greatest groups that nothing can split any more are taken
off together: their previous-smaller pointers are the neighbours to their left that are
left over, and those neighbours' groups are split by what was appended to them.

Phase two fills the suffix array from left to right. Within a group suffixes are ordered
as what follows their Lyndon word, their next smaller suffixes; so whenever a stretch of
the array is known, the suffixes whose next smaller suffix stands in it are put, in this
order, into the next free places of their groups. Nothing is renamed or sorted anew.
"""

from __future__ import annotations


def _split(group, order_key, starts, counts, member):
    """Split groups by sequences, lexicographically, a shorter sequence before a longer one.

    group: the group of each node, the place where it starts among its kind (changed in
    place). order_key: all sequences in a row; node i's is order_key[starts[i]:][:counts[i]].
    member: the nodes that are split; whole groups.
    """
    import numpy as np

    t = 0
    while len(member):
        has = counts[member] > t
        if not has.any():
            return
        key = np.where(has, order_key[np.where(has, starts[member] + t, 0)], -1)
        own = group[member]
        order = np.argsort((own.astype(np.int64) << 32) | (key.astype(np.int64) + 1), kind="stable")
        member, own, key = member[order], own[order], key[order]
        new_group = np.empty(len(member), bool)
        new_group[0] = True
        new_group[1:] = own[1:] != own[:-1]
        new_part = new_group.copy()
        new_part[1:] |= key[1:] != key[:-1]
        place = np.arange(len(member))
        inside = place - np.maximum.accumulate(np.where(new_group, place, 0))
        first = np.maximum.accumulate(np.where(new_part, place, 0))
        own = own + inside[first]
        group[member] = own
        # On with parts of more than one node that aren't all at their end.
        size = np.diff(np.append(np.flatnonzero(new_part), len(member)))
        part = np.cumsum(new_part) - 1
        member = member[(size[part] > 1) & (key >= 0)]
        t += 1


def lyndon_groups(text):
    """Phase one. text: codes from 0 to 256, 0 a separator, which must come last.

    Returns (the place where each suffix's group starts, each suffix's next smaller suffix).
    """
    import numpy as np

    n = len(text)
    rank = np.zeros(n, np.int32)
    nss = np.zeros(n, np.int32)
    below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=258))])
    children: dict[int, list] = {}
    alive = np.arange(n, dtype=np.int32)
    zeros, firsts = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for c in np.unique(text)[:0:-1].tolist():
        if c == 0:
            break
        kind = text[alive] == c
        at = np.flatnonzero(kind)
        nodes = alive[at]
        m = len(nodes)
        group = np.zeros(m, np.int32)
        # Children with a greater first character are all ordered by now.
        kids = children.pop(c, None)
        if kids:
            kid = np.sort(np.concatenate(kids))
            parent = np.searchsorted(nodes, kid, side="right") - 1
            counts = np.bincount(parent, minlength=m)
            _split(group, rank[kid], np.cumsum(counts) - counts, counts, np.arange(m))
        # Chains: nodes that stand side by side among those left.
        chain = np.cumsum(np.concatenate([[True], np.diff(at) != 1]))
        before = np.where(at > 0, alive[np.maximum(at - 1, 0)], -1)
        after = alive[np.minimum(at + 1, len(alive) - 1)]
        left_of = before[np.searchsorted(chain, chain, side="left")]
        right_of = after[np.searchsorted(chain, chain, side="right") - 1]
        # Nodes in order of their groups; a group that starts at place p is order[p : p + size[p]].
        order = np.argsort(group, kind="stable")
        size = np.bincount(group, minlength=m)
        where = np.arange(m)
        follow = np.where(np.append(chain[1:], 0) == chain, where + 1, -1)
        precede = np.where(np.concatenate([[0], chain[:-1]]) == chain, where - 1, -1)
        taken = np.zeros(m + 1, bool)
        # The place of each node in order, and a mark for those that move.
        spot = np.empty(m, np.int64)
        spot[order] = where
        mark = np.zeros(m, bool)
        left = m
        while left:
            # A look at the greatest nodes: those with a greater neighbour to the right (equals skipped) will be split yet.
            low = group[order[max(left - 64 - 2 * int(left**0.5), 0)]]
            top = order[low:left]
            mine = group[top]
            after = follow[top]
            same = np.flatnonzero((after >= 0) & (group[after] == mine))
            while len(same):
                after[same] = follow[after[same]]
                same = same[(after[same] >= 0) & (group[after[same]] == mine[same])]
            rising = (after >= 0) & (group[after] > mine)
            if rising.any():
                limit = mine[rising].max()
                low = limit + size[limit]
            out = order[low:left]
            left = low
            rank[nodes[out]] = below[c] + group[out]
            # Next smaller: the neighbour to the right; previous smaller: the nearest to the left that stays.
            right = follow[out]
            nss[nodes[out]] = np.where(right >= 0, nodes[right], right_of[out])
            taken[out] = True
            stay = precede[out]
            chase = np.flatnonzero((stay >= 0) & taken[stay])
            while len(chase):
                stay[chase] = precede[stay[chase]]
                chase = chase[(stay[chase] >= 0) & taken[stay[chase]]]
            edge = (right < 0) | ~taken[right]
            ends_at, back_to = right[edge], stay[edge]
            follow[back_to[back_to >= 0]] = ends_at[back_to >= 0]
            precede[ends_at[ends_at >= 0]] = back_to[ends_at >= 0]
            outer = out[stay < 0]
            boundary = left_of[outer]
            outer, boundary = outer[boundary >= 0], boundary[boundary >= 0]
            if len(outer):
                codes = text[boundary]
                for code in np.unique(codes).tolist():
                    if code:
                        children.setdefault(code, []).append(nodes[outer[codes == code]])
            if (stay >= 0).any():
                # Neighbours that stay: split their groups by what they got, in order of place.
                by = np.sort(out[stay >= 0])
                got = stay[stay >= 0][np.argsort(out[stay >= 0])]
                start = np.flatnonzero(np.concatenate([[True], got[1:] != got[:-1]]))
                counts, starts = zeros[:m], firsts[:m]
                counts[got[start]] = np.diff(np.append(start, len(got)))
                starts[got[start]] = start
                # The others of their groups got nothing and come first: they stay where they are, those that got something go behind them.
                moved = got[start]
                moved = moved[np.argsort(group[moved], kind="stable")]
                own = group[moved]
                head = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                many = np.diff(np.append(head, len(own)))
                size[own[head]] -= many
                behind = np.repeat(own[head] + size[own[head]], many)
                places = behind + np.arange(len(own)) - np.repeat(head, many)
                mark[moved] = True
                there = order[places]
                there = there[~mark[there]]
                mark[moved] = False
                freed = spot[moved]
                freed = freed[freed < behind]
                order[freed] = there
                spot[there] = freed
                group[moved] = behind
                _split(group, group[by], starts, counts, moved)
                counts[moved] = 0
                moved = moved[np.argsort(group[moved], kind="stable")]
                order[places] = moved
                spot[moved] = places
                own = group[moved]
                head = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                size[own[head]] = np.diff(np.append(head, len(own)))
        alive = alive[~kind]
    return rank, nss


def suffix_array(text):
    """Places of all suffixes in ascending order; separators come first, in text order."""
    import numpy as np

    n = len(text)
    rank, nss = lyndon_groups(text)
    separators = np.flatnonzero(text == 0).astype(np.int32)
    by_next = np.flatnonzero(text != 0).astype(np.int32)
    by_next = by_next[np.argsort(nss[by_next], kind="stable")]
    number = np.bincount(nss[by_next], minlength=n)
    first = np.cumsum(number) - number
    array = np.zeros(n, np.int32)
    filled = np.zeros(n + 1, bool)
    free = np.zeros(n, np.int32)
    lo, hi = 0, len(separators)
    array[:hi] = separators
    filled[:hi] = True
    while lo < hi:
        source = array[lo:hi]
        k = number[source]
        source, k = source[k > 0], k[k > 0]
        total = int(k.sum())
        if total:
            index = np.repeat(first[source] - np.cumsum(k) + k, k) + np.arange(total)
            placed = by_next[index]
            own = rank[placed]
            order = np.argsort(own, kind="stable")
            sorted_own = own[order]
            turn = np.empty(total, bool)
            turn[0] = True
            turn[1:] = sorted_own[1:] != sorted_own[:-1]
            start = np.flatnonzero(turn)
            sizes = np.diff(np.append(start, total))
            heads = sorted_own[start]
            slot = sorted_own + free[sorted_own] + (np.arange(total) - np.repeat(start, sizes))
            array[slot] = placed[order]
            filled[slot] = True
            free[heads] += sizes.astype(np.int32)
        lo = hi
        while hi < n:
            stretch = filled[hi : hi + 4096]
            gap = int(stretch.argmin())
            if not stretch[gap]:
                hi += gap
                break
            hi += len(stretch)
        hi = min(hi, n)
    return array
