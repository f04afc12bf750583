"""Groups and their pruning as programs over lists: what grouping.py is held to."""

from __future__ import annotations


def guarded_groups(pairs: list[tuple], alike) -> tuple[dict, int]:
    """Groups of one component: {member: (group, difference, flags)} and blocked merges.

    pairs: (a, b, difference, flags) in the order of comparison. A pair of new members makes a
    group whose representative is its first one; a member joins, or groups merge, only if the
    representatives are alike. A joining member keeps the difference of the pair that brought
    it; in a new group flags go to the second member only.
    """
    group, facts, rep, blocked = {}, {}, {}, 0
    for a, b, difference, flags in pairs:
        ga, gb = group.get(a), group.get(b)
        if ga is None and gb is None:
            group[a] = group[b] = a
            rep[a] = a
            facts[a], facts[b] = (difference, 0), (difference, flags)
        elif ga is not None and gb is not None:
            if ga == gb:
                continue
            if alike(rep[ga], rep[gb]):
                for m in [m for m, g in group.items() if g == gb]:
                    group[m] = ga
            else:
                blocked += 1
        else:
            old, new = (a, b) if ga is not None else (b, a)
            g = group[old]
            if alike(rep[g], new):
                group[new] = g
                facts[new] = (difference, flags)
            else:
                blocked += 1
    return {m: (g, *facts[m]) for m, g in group.items()}, blocked


def pruned(members: list, alike) -> list[list]:
    """Groups of a chain: the member with the fewest similar ones goes (the first of equals)
    while it has less than half of the rest; what has gone is grouped again by its links."""
    out, waiting = [], [sorted(members)]
    while waiting:
        now, gone = waiting.pop(), []
        while len(now) >= 3:
            links = [sum(alike(m, o) for o in now if o != m) for m in now]
            least = min(range(len(now)), key=lambda i: (links[i], i))
            if links[least] >= len(now) // 2:
                break
            gone.append(now.pop(least))
        if len(now) >= 2:
            out.append(now)
        left = set(gone)
        while left:
            part, edge = set(), [min(left)]
            while edge:
                m = edge.pop()
                part.add(m)
                edge += [o for o in left - part - set(edge) if alike(m, o)]
            left -= part
            if 2 <= len(part) < len(members):
                waiting.append(sorted(part))
    return out
