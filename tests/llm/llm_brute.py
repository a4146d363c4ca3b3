"""Plain versions of the operators, for small tables."""

import math
import re
import zlib
from collections import Counter

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")

CLASHING = "row string, shard string, kept string, node string, size string, block string, words string, _kept string, h string"
CLASH_VALUES = ("r", "s", "k", "n", "z", "b", "w", "x", "h")


def words(text):
    return WORD.findall((text or "").translate(ASCII_LOWER))


def shingles(text, width):
    w = words(text)
    if len(w) >= width:
        return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1))
    return frozenset([tuple(w)] if w else [])


def groups(rows, width, num, den):
    """Group number of each row (key, text); rows without words are alone."""
    sets = [shingles(text, width) for _, text in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and den * len(a & sets[j]) >= num * len(a | sets[j]):
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(rows))], sets


def leaks(docs, items, limit=0.8, width=5):
    """{row number: {item id: best similarity}} over all item-sized windows."""

    def grams(w, size):
        k = min(size, width)
        return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]

    held = {}
    for item_id, text in items:
        w = (text or "").lower().split()
        if w:
            held[item_id] = (len(w), grams(w, len(w)))
    df = Counter(g for _, gs in held.values() for g in set(gs))
    weight = lambda g: math.log(1 + len(held) / df.get(g, 1))
    out = {}
    for row, text in enumerate(docs):
        w = (text or "").lower().split()
        best = {}
        for item_id, (size, gs) in held.items():
            want = Counter(gs)
            mine = grams(w, size)
            for a in range(max(1, len(w) - size + 1)):
                have = Counter(mine[a : a + len(gs)])
                keys = set(have) | set(want)
                total = sum(weight(g) * max(have[g], want[g]) for g in keys)
                value = sum(weight(g) * min(have[g], want[g]) for g in keys) / total
                if value >= limit - 1e-12:
                    best[item_id] = max(best.get(item_id, 0), value)
        out[row] = best
    return out


def lm_scores(rows, discount=0.75):
    """(held out, tokens, known, N, base, score) of each row (doc_id, text), unquantised."""
    tokens = [[*words(t), None] for _, t in rows]
    held = [zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2 for d, _ in rows]
    train = [t for t, h in zip(tokens, held) if not h]
    count = Counter(x for t in train for x in t)
    n, v = sum(count.values()), len(count)
    pairs = Counter(p for t in train for p in zip(["<begin>", *t], t))
    width = Counter(u for u, _ in pairs)
    count["<begin>"] = len(train)
    out = []
    for t, h in zip(tokens, held):
        score = 0.0
        for a, b in zip(["<begin>", *t], t):
            p = (count[b] + 1) / (n + v + 1)
            if width[a]:
                p = (max(pairs[a, b] - discount, 0) + discount * width[a] * p) / count[a]
            score += math.log10(p)
        base = sum(math.log10((count[x] + 1) / (n + v + 1)) for x in t)
        out.append((h, len(t), sum(count[x] > 0 for x in t), n, base, score))
    return out
