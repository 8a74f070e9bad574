"""Plain Python versions of the operators' definitions."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import combinations

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_BLANK = re.compile(r"[^\x20\x09-\x0D]+")
_ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def blank_words(text):
    return _BLANK.findall(text or "")


def alnum_words(text):
    return _ALNUM.findall((text or "").translate(_LOWER))


def shingles(text, width=5):
    words = [w.translate(_LOWER) for w in blank_words(text)]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    return {n: find(n) for n in nodes}


def near_components(texts: dict, percent=80):
    sets = {k: shingles(t) for k, t in texts.items()}
    links = [
        (a, b) for a, b in combinations(sets, 2)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    return {k: len(s) for k, s in sets.items()}, roots(sets, links)


def base_counts(text):
    words = blank_words(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if blank_words(x)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum((text or "").count(c) for c in "#*$%&|<>"),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "base_failed": len(words) < 10 or 100 * len(covered) > 20 * len(words),
    }


def leaks(text, items: dict, width=10):
    words = alnum_words(text)
    covered, names = set(), set()
    for item, passage in items.items():
        parts = alnum_words(passage)
        size = min(width, len(parts))
        wanted = {tuple(parts[i : i + size]) for i in range(len(parts) - size + 1)} if size else set()
        for i in range(len(words) - size + 1 if size else 0):
            if tuple(words[i : i + size]) in wanted:
                covered.update(range(i, i + size))
                names.add(item)
    return len(words), covered, names


def grouped(rows, key):
    out = defaultdict(list)
    for row in rows:
        out[row[key]].append(row)
    return out
