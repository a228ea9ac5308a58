"""Plain-Python forms of the operators, and a small table with every awkward case."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from hashlib import sha256

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def awkward(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, and names that operators use inside."""
    base = "The quick brown fox jumps over the lazy dog while rain falls on quiet hills and rivers run to distant seas. "
    prose = " ".join(f"w{i % 97}x{i}" for i in range(180))
    near = prose.replace("w3x100", "changed")
    rows = [
        (1, prose, "en", "a"), (2, near, "en", None), (3, prose, None, "a"), (4, None, "en", "a"), (5, "", "de", "b"),
        (6, "  \n\t ", "de", "b"), (7, "one two", "fr", "b"), (8, "one two", "fr", "b"), (9, base * 400, "en", "c"),
        (9, base * 400, "en", "c"), (10, "x" * 200_000, "en", "c"), (11, "!!! ### $$$", None, None),
        (None, prose, "en", "a"), (None, None, None, None), (12, "éß\U0001f642 漢字 " * 30, "de", "d"),
        (13, "line one\nline one\nline two", "en", "d"), (14, "head " + " ".join(words(prose)[20:120]) + " tail", "en", "d"),
        (14, "same id, other text", "en", "d"),
    ]
    names = ["k", "n", "h", "keys", "bag", "spans", "slot", "shard", "pattern", "ids", "root"]
    return spark.createDataFrame(
        [r + tuple(f"{c}{i}" if i % 3 else None for c in names) for i, r in enumerate(rows)],
        "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in names))


def substring_removal(rows, size):
    first = {}
    for doc, text in rows:
        w = words(text)
        for i in range(len(w) - size + 1):
            key = tuple(w[i: i + size])
            if doc is not None and doc < first.get(key, doc + 1):
                first[key] = doc
    out = []
    for doc, text in rows:
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if doc is not None and first[tuple(w[i: i + size])] < doc:
                gone[i: i + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((doc, len(w), sum(gone), sha256(kept.encode()).hexdigest()))
    return out


def bag(text):
    w = words(text)
    if len(w) < 5:
        return Counter([tuple(w)] if w else [])
    return Counter(tuple(w[i: i + 5]) for i in range(len(w) - 4))


def near_classes(rows):
    """{doc_id: smallest id of its class}"""
    parent = {d: d for d, _ in rows if d is not None}
    holders = defaultdict(list)
    bags = [(d, bag(t)) for d, t in rows if d is not None]
    for i, (_, b) in enumerate(bags):
        for s in b:
            holders[s].append(i)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    pairs = {(v[i], v[j]) for v in holders.values() for i in range(len(v)) for j in range(i + 1, len(v))}
    for i, j in pairs:
        (a, x), (b, y) = bags[i], bags[j]
        if 9 * (x & y).total() >= 4 * (x.total() + y.total()):
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    return {d: find(d) for d in parent}


def base_counts(text):
    w = words(text)
    n = len(w)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i: i + 5]) for i in range(n - 4))
    covered = [False] * n
    for i in range(n - 4):
        if grams[tuple(w[i: i + 5])] > 1:
            covered[i: i + 5] = [True] * 5
    repeat = sum(covered)
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, repeat, n < 10 or 100 * repeat > 20 * n)
