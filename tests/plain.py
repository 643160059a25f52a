"""Matching by definition, on lists: what the plans are held against."""

import math
from itertools import combinations


def vector(ra, dec):
    a, d = math.radians(ra), math.radians(dec)
    return math.cos(d) * math.cos(a), math.cos(d) * math.sin(a), math.sin(d)


def separation(p, q):
    """Arcseconds between two positions."""
    return 2 * math.asin(min(1.0, math.dist(vector(*p), vector(*q)) / 2)) * 648000 / math.pi


def pairs(left, right, radius):
    return {(i, j): s for i, p in enumerate(left) for j, q in enumerate(right) if (s := separation(p, q)) <= radius}


def components(nodes, links):
    """Sorted node lists; ``links`` are pairs."""
    label = {n: n for n in nodes}
    while True:
        before = dict(label)
        for m, n in links:
            label[m] = label[n] = min(label[m], label[n])
        if label == before:
            break
    out = {}
    for n in sorted(nodes):
        out.setdefault(label[n], []).append(n)
    return list(out.values())


def dedupe(places, radius):
    """``{row: (status, kept row)}`` of dropped and disputed rows."""
    links = {(i, j) for (i, j) in pairs(places, places, radius) if i < j} if radius else set()
    out = {}
    for group in components(range(len(places)), links):
        whole = all(p in links for p in combinations(group, 2))
        out |= {n: ("dropped", group[0]) if whole else ("disputed", None) for n in (group[1:] if whole else group)}
    return out


def policy(found, name):
    """The pairs ``{(i, j): separation}`` that a policy keeps."""
    own = {i: [(s, j) for (x, j), s in found.items() if x == i] for i, _ in found}
    back = {j: [(s, i) for (i, x), s in found.items() if x == j] for _, j in found}

    def chosen(side, n, other):
        return min(side[n])[1] == other if name.endswith("nearest") else len(side[n]) == 1

    return {(i, j): s for (i, j), s in found.items() if chosen(own, i, j) and (name.startswith("anchored") or chosen(back, j, i))}


def complete(group, link):
    return all(frozenset(p) in link for p in combinations(group, 2))


def split(nodes, link):
    """All merges there are, the best one first, until none is left."""
    groups = {(n,) for n in nodes}
    worst = lambda g: max(link[frozenset(p)] for p in combinations(g, 2))
    while True:
        merges = []
        for a, b in combinations(sorted(groups), 2):
            both = tuple(sorted(a + b))
            if complete(both, link):
                merges.append((max(link[frozenset((m, n))] for m in a for n in b), both, a, b))
        if not merges:
            return groups
        _, both, a, b = min(merges)
        assert worst(both) >= worst(a) if len(a) > 1 else True
        groups = groups - {a, b} | {both}


def sequential(nodes, link, priority):
    groups = []
    for survey in priority:
        rows, closed = sorted(n for n in nodes if n[0] == survey), [tuple(g) for g in groups]
        while True:
            offers = [
                (max(link[frozenset((n, m))] for m in g), n, k)
                for k, g in enumerate(closed)
                if g == tuple(groups[k])
                for n in rows
                if all(frozenset((n, m)) in link for m in g)
            ]
            if not offers:
                break
            _, n, k = min(offers)
            groups[k].append(n)
            rows.remove(n)
        groups += [[n] for n in rows]
    return {tuple(sorted(g)) for g in groups}


def entities(counts, link, disputed, resolver="refuse", priority=None, size_cap=30, drop=False, least=1, include=()):
    """Rows ``(row of each survey..., reason)`` of an entitywise match; ``link`` has frozensets of nodes."""
    names = sorted(counts)
    gone = {(names.index(n), r) for n, rows in disputed.items() for r in rows}
    nodes = [(s, r) for s, n in enumerate(names) for r in range(counts[n]) if (s, r) not in gone]
    out = [] if drop else [((n,), "dedupe_disputed") for n in gone]
    for group in components(nodes, [tuple(sorted(p)) for p in link]):
        if complete(group, link):
            out.append((tuple(group), None))
        elif resolver == "refuse" or len(group) > size_cap:
            out += [] if drop else [((n,), "ambiguous_component") for n in group]
        else:
            ranks = [names.index(n) for n in priority or names]
            own = split(group, link) if resolver == "split" else sequential(group, link, ranks)
            out += [(g, None) for g in own]
    rows = []
    for group, why in out:
        at = dict(group)
        if len(group) >= least and all(names.index(n) in at for n in include):
            rows.append((*(at.get(s) for s in range(len(names))), why))
    return sorted(rows, key=lambda t: tuple((x is None, x) for x in t))
