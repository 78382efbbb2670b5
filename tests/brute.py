"""Slow twins of the kernels, written straight from their definitions."""

import random

P = 2**61 - 1


def word_value(w):
    return sum(ord(c) * 31 ** (len(w) - 1 - i) for i, c in enumerate(w)) % P


def shingles(words, k):
    return [sum(word_value(w) * 257 ** (k - 1 - i) for i, w in enumerate(words[s:s + k])) % P for s in range(len(words) - k + 1)] if k > 0 else []


def winnow(h, w):
    if not h or w <= 0:
        return []
    w = min(w, len(h))
    return sorted({min(range(s, s + w), key=lambda i: (h[i], -i)) for s in range(len(h) - w + 1)})


def minhash(values, n, seed):
    rng = random.Random(seed)
    perms = [(rng.randrange(1, P), rng.randrange(0, P)) for _ in range(n)]
    return [min(((a * v + b) % P for v in values), default=P) for a, b in perms]


def local_alignment(a, b, match=2.0, mismatch=-1.0, gap=-1.5):
    """Score matrix cell by cell; diagonal before up before left on ties."""
    score, move = {}, {}
    best, cell = 0.0, None
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            ways = [(score.get((i - 1, j - 1), 0.0) + (match if a[i - 1] == b[j - 1] else mismatch), 2), (score.get((i - 1, j), 0.0) + gap, 1), (score.get((i, j - 1), 0.0) + gap, 0)]
            s, m = max(ways)
            score[i, j], move[i, j] = (s, m) if s > 0 else (0.0, -1)
            if s > best:
                best, cell = s, (i, j)
    if cell is None:
        return 0, -1, 0, -1, 0.0
    i, j = cell
    places = hits = 0
    while i and j and move[i, j] >= 0:
        places += 1
        hits += move[i, j] == 2 and a[i - 1] == b[j - 1]
        i, j = {2: (i - 1, j - 1), 1: (i - 1, j), 0: (i, j - 1)}[move[i, j]]
    return i, cell[0] - 1, j, cell[1] - 1, hits / places
