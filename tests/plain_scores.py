"""Plain Python versions of the text scores, to compare with."""

from functools import lru_cache


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b):
            left, row[j + 1] = row[j + 1], left + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def share(distance, size):
    return 100.0 if size == 0 else 100.0 * (1.0 - distance / size)


@lru_cache(None)
def ratio(a, b):
    return share(len(a) + len(b) - 2 * lcs(a, b), len(a) + len(b))


def partial_ratio(a, b):
    if not a or not b:
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    windows = [b[max(p, 0):p + len(a)] for p in range(1 - len(a), len(b))]
    best = max(ratio(a, w) for w in windows)
    return best if len(a) < len(b) else max(best, max(ratio(b, a[max(p, 0):p + len(b)]) for p in range(1 - len(b), len(a))))


def token_set_ratio(a, b):
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, p, q = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and not (p and q):
        return 100.0
    gap = 1 if both else 0
    sp, sq = len(both) + gap + len(p), len(both) + gap + len(q)
    scores = [share(len(p) + len(q) - 2 * lcs(p, q), sp + sq)]
    if both:
        scores += [share(gap + len(p), len(both) + sp), share(gap + len(q), len(both) + sq)]
    return max(scores)


def weighted_ratio(a, b):
    if not a or not b:
        return 0.0
    times = max(len(a), len(b)) / min(len(a), len(b))
    p, q = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    if times < 1.5:
        return max(ratio(a, b), 0.95 * max(ratio(p, q), token_set_ratio(a, b)))
    scale = 0.9 if times <= 8 else 0.6
    words = 0.0 if not p or not q else 100.0 if set(a.split()) & set(b.split()) else partial_ratio(p, q)
    return max(ratio(a, b), partial_ratio(a, b) * scale, words * 0.95 * scale)
