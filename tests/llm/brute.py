"""Brute-force versions of the operators, in plain Python."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import combinations

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(lower(text))


def shingles(text, width=5):
    w = words(text)
    if not w:
        return Counter()
    size = min(width, len(w))
    return Counter(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def weighted_jaccard(a: Counter, b: Counter) -> float:
    low = sum((a & b).values())
    return low / (sum(a.values()) + sum(b.values()) - low)


def groups(items, links):
    """Component label (smallest item) of each item."""
    root = {i: i for i in items}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in items}


def near_duplicate_classes(docs, similarity=0.8):
    """{doc_id: class_id} by all pairs that share a shingle."""
    bags = {i: shingles(t) for i, t in docs.items()}
    by_shingle = defaultdict(list)
    for i, bag in bags.items():
        for s in bag:
            by_shingle[s].append(i)
    pairs = set()
    for ids in by_shingle.values():
        pairs.update(combinations(sorted(ids), 2))
    return groups(docs, [p for p in pairs if weighted_jaccard(bags[p[0]], bags[p[1]]) >= similarity])


def plain_line(line):
    return " ".join(words(line.lower()))


def edit_distance(a, b):
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def line_groups(lines, similarity=0.9):
    """{plain line: label} by the edit distance of all pairs of distinct plain lines."""
    lines = sorted(set(lines))
    links = []
    for i, a in enumerate(lines):
        for b in lines[i + 1 :]:
            edits = max(len(a), len(b)) * (1 - similarity) + 1e-9
            if abs(len(a) - len(b)) <= edits and edit_distance(a, b) <= edits:
                links.append((a, b))
    return groups(lines, links)
