"""Plain versions of operators, for small tables."""

from __future__ import annotations

import collections
import re

BLANK_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingle_set(text, size):
    w = BLANK_WORD.findall(lower(text))
    if len(w) >= size:
        return frozenset(zip(*[w[k:] for k in range(size)]))
    return frozenset([tuple(w)] if w else [])


def near_classes(rows, size, percent=80):
    """(number of shingles, smallest row number reachable) per row of texts."""
    sets = [shingle_set(t, size) for t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = collections.defaultdict(list)
    for k, s in enumerate(sets):
        shared = collections.Counter()
        for x in s:
            shared.update(where[x])
            where[x].append(k)
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(k), find(j)
                root[max(a, b)] = min(a, b)
    return [(len(s), find(k)) for k, s in enumerate(sets)]


def kept_words(texts, length):
    """(number of words, number removed, words left) per text."""
    docs = [BLANK_WORD.findall(t or "") for t in texts]
    seen = collections.Counter(
        tuple(d[k:k + length]) for d in docs for k in range(len(d) - length + 1))
    out = []
    for d in docs:
        gone = set()
        for k in range(len(d) - length + 1):
            if seen[tuple(d[k:k + length])] > 1:
                gone.update(range(k, k + length))
        out.append((len(d), len(gone), " ".join(w for k, w in enumerate(d) if k not in gone)))
    return out
