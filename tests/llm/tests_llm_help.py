"""Plain restatements that the tests compare with."""

import re
from collections import defaultdict

from compare import same

__all__ = ["ALNUM", "SPACED", "benchmark_windows", "groups", "hits", "same", "shingles", "words"]
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def words(text, pattern):
    return pattern.findall((text or "").translate(LOWER))


def shingles(text, k, pattern=SPACED):
    w = words(text, pattern)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def benchmark_windows(items):
    """The items that have each window of 13 words (of all words, if an item has fewer)."""
    windows = defaultdict(set)
    for r in items:
        w = words(r["text"], ALNUM)
        k = min(13, len(w))
        for a in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[a : a + k])].add(r["item_id"])
    return windows


def hits(text, windows):
    """(words, places of words inside occurrences, items found) of a text."""
    w, hit, found = words(text, ALNUM), set(), set()
    for k in sorted({len(x) for x in windows}):
        for a in range(len(w) - k + 1):
            if x := windows.get(tuple(w[a : a + k])):
                hit |= set(range(a, a + k))
                found |= x
    return w, hit, found


def groups(pairs, nodes):
    """The least node reachable from each."""
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}
