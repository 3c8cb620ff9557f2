"""Plain one-machine versions of the operators' results, for small tables."""

from __future__ import annotations

import collections
import hashlib
import math
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def base(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    text = text or ""
    w = words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = collections.Counter(tuple(w[k:k + 3]) for k in range(len(w) - 2))
    hit = [False] * len(w)
    for k in range(len(w) - 2):
        if grams[tuple(w[k:k + 3])] > 1:
            hit[k] = hit[k + 1] = hit[k + 2] = True
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, sum(hit)


def substring(docs, width=13):
    """[(doc_id, n_words, n_removed, kept_sha256)] by row; docs: [(doc_id, text)]."""
    starts = collections.defaultdict(lambda: math.inf)
    low = lambda i: -math.inf if i is None else i
    for i, t in docs:
        w = words(t)
        for k in range(len(w) - width + 1):
            g = tuple(w[k:k + width])
            starts[g] = min(starts[g], low(i))
    out = []
    for i, t in docs:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if starts[tuple(w[k:k + width])] < low(i):
                gone[k:k + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def shingles(text, width=5):
    w = words(text)
    if not w:
        return collections.Counter()
    if len(w) < width:
        return collections.Counter([tuple(w)])
    return collections.Counter(tuple(w[k:k + width]) for k in range(len(w) - width + 1))


def near_classes(docs, threshold=0.8):
    """{doc_id: class} by all pairs, weighted Jaccard over TF-IDF shingles; docs: [(doc_id, text)], ids distinct."""
    s = {i: shingles(t) for i, t in docs}
    df = collections.Counter(x for c in s.values() for x in c)
    n = len(docs)
    w = {i: {x: k * (1 + math.log1p(n / df[x]) / math.log1p(max(n, 1))) for x, k in c.items()} for i, c in s.items()}
    total = {i: sum(c.values()) for i, c in w.items()}
    parent = {i: i for i in s}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(s)
    holders = collections.defaultdict(list)
    for i in ids:
        for x in w[i]:
            holders[x].append(i)
    common = collections.Counter()
    for x, of in holders.items():
        for p, a in enumerate(of):
            for b in of[p + 1:]:
                common[a, b] += min(w[a][x], w[b][x])
    for (a, b), c in common.items():
        if c / (total[a] + total[b] - c) >= threshold:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def targets(sizes, weights=(5, 2, 1), most=3):
    """{source: target} by resharing step by step; sizes: {source: size}."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, fixed, free = sum(sizes.values()), {}, set(sizes)
    while free:
        left, share = total - sum(fixed.values()), sum(w[s] for s in free)
        over = [s for s in free if left * w[s] / share > most * sizes[s]]
        if not over:
            fixed.update({s: left * w[s] / share for s in free})
            break
        fixed.update({s: float(most * sizes[s]) for s in over})
        free -= set(over)
    return fixed


def fewest_bins(lengths, capacity):
    """Exact minimum of bins for a few lengths (branch and bound)."""
    lengths = sorted(lengths, reverse=True)
    best = len(lengths)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for k in sorted(set(rooms)):
            if k >= lengths[i]:
                r = list(rooms)
                r.remove(k)
                go(i + 1, [*r, k - lengths[i]])
        go(i + 1, [*rooms, capacity - lengths[i]])

    go(0, [])
    return best
