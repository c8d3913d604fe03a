"""Plain reference computations for small inputs."""

from __future__ import annotations

import re
from collections import Counter, defaultdict


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", low(text))


def shingles(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def groups(texts, percent=85):
    """{id: (set size, smallest linked id)} by comparing all that share a shingle."""
    sets = {i: shingles(t) for i, t in texts.items()}
    where = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            where[g].append(i)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    seen = set()
    for ids in where.values():
        for x in range(len(ids)):
            for y in ids[:x]:
                if (p := (y, ids[x])) in seen:
                    continue
                seen.add(p)
                a, b = sets[y], sets[ids[x]]
                both = len(a & b)
                if 100 * both >= percent * (len(a) + len(b) - both):
                    r, s = find(y), find(ids[x])
                    parent[max(r, s)] = min(r, s)
    return {i: (len(sets[i]), find(i)) for i in sets}


def edits(a, b):
    """Insertions, deletions and substitutions from a to b."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def plain_words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower().strip(" \t\n\x0b\x0c\r")) if w]


def window_similarity(text, item, k=5):
    """The best weighted Jaccard similarity of an item and any window of its length, or the whole of a shorter text."""
    a, b = plain_words(text), plain_words(item)
    k = min(k, len(b))
    if not b or len(a) < k:
        return 0.0
    grams = lambda w: Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    own = grams(b)
    if not own & grams(a):
        return 0.0
    best = 0.0
    for i in range(max(0, len(a) - len(b)) + 1):
        held = grams(a[i : i + len(b)])
        both = sum((held & own).values())
        best = max(best, both / (sum(held.values()) + sum(own.values()) - both))
    return best
