"""Per-document kernels for what Catalyst cannot express: folding with offsets, winnowing and MinHash, alignment.

They run in Arrow batches; a document is always handled whole, and none needs another document.
"""

from __future__ import annotations

import functools
import html
import random
import re
import unicodedata
from collections import Counter
from typing import NamedTuple

import numpy as np

from palimpsest.config import ABBREVIATIONS, DISCOURSE_MARKERS, FUNCTION_WORDS, PRIME, QUERY_STOPWORDS, AlignConfig, FingerprintConfig

# --- normalization ----------------------------------------------------------------------------

# Characters that vanish, and characters with a plain form of their own.
VANISH = "\u200b\u200c\u200d\u2060\ufeff\u00ad"
PLAIN = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s",
    "А": "A", "Е": "E", "О": "O", "Р": "P", "С": "C", "У": "Y", "Х": "X", "І": "I",
    "ο": "o", "α": "a", "ε": "e", "ρ": "p", "ν": "v", "Β": "B", "Ο": "O", "Ι": "I",
    "“": '"', "”": '"', "„": '"', "«": '"', "»": '"',
    "‘": "'", "’": "'", "‚": "'", "‹": "'", "›": "'",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "―": "-", "−": "-",
    "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "æ": "ae", "œ": "oe",
}
# The grammars of tokens, broken words, sentence ends, quotations, citations and reference headings.
TOKEN = re.compile(r"[A-Za-z0-9]+(?:'[A-Za-z]+)?")
BREAK = re.compile(r"-[ \t]*\r?\n[ \t]*(?=[a-z])")
STOP = re.compile(r"[.!?][\"')\]]*(?=\s|\Z)")
QUOTES = (re.compile(r'"([^"]{8,600})"'), re.compile(r"(?:^|\n)(?:[ ]{4,}|\t)(\S[^\n]{20,})", re.M))
CITED = re.compile(
    r"\((?:[A-Z][A-Za-z'-]+(?:\s+(?:et\s+al\.?|and|&)\s+[A-Z][A-Za-z'-]+)?(?:,\s*)?(?:19|20)\d{2}[a-z]?(?:,\s*(?:p{1,2}\.?\s*)?\d+(?:-\d+)?)?)\)"
    r"|\[\d{1,3}(?:\s*[,-]\s*\d{1,3})*\]")
REFERENCES = re.compile(r"(?<!\S)(?:references|bibliography|works\s+cited|literature\s+cited)\s*:?\s*$", re.I | re.M)


@functools.cache
def plain_form(c: str) -> str:
    if c in VANISH:
        return ""
    return PLAIN[c] if c in PLAIN else "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))


def fold(raw: str) -> tuple[str, np.ndarray]:
    """(plain text, for each of its characters the index in raw)."""
    if raw.isascii():
        return raw, np.arange(len(raw))
    forms = list(map(plain_form, raw))
    return "".join(forms), np.repeat(np.arange(len(raw)), list(map(len, forms)))


class Normalized(NamedTuple):
    text: str
    at: np.ndarray
    words: list[str]
    spans: list[tuple[int, int]]
    sentences: list[tuple[int, int]]
    exclusions: list[tuple[int, int, str]]


def _ends_no_sentence(before: str) -> bool:
    last = (before.split() or [""])[-1].casefold().rstrip(".")
    return last in ABBREVIATIONS or (len(last) == 1 and last.isalpha())


def _references(text: str) -> int | None:
    """Where the last reference heading begins: at the first line of white space that leads to it and nothing else."""
    found, before = None, 0
    for m in REFERENCES.finditer(text):
        start = max(len(text[:m.start()].rstrip()), before)  # white space an earlier heading took is not ours
        begin = start if not start or text[start - 1] == "\n" else text.find("\n", start, m.start()) + 1
        if begin or not start:
            found, before = begin, m.end()
    return found


def merged(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Overlapping or touching spans of one kind become one."""
    out: dict[str, list[list[int]]] = {}
    for s, e, kind in sorted(spans):
        run = out.setdefault(kind, [])
        if run and s <= run[-1][1]:
            run[-1][1] = max(run[-1][1], e)
        else:
            run.append([s, e])
    return sorted((s, e, kind) for kind, run in out.items() for s, e in run)


def normalize(raw: str) -> Normalized:
    text, at = fold(raw)
    cut = [m.span() for m in BREAK.finditer(text)]
    if cut:
        keep = np.ones(len(text), bool)
        for s, e in cut:
            keep[s:e] = False
        text, at = BREAK.sub("", text), at[keep]
    found = list(TOKEN.finditer(text))
    words = [m[0].casefold() for m in found]
    spans = [(int(at[m.start()]), int(at[m.end() - 1]) + 1) for m in found]

    def raw_span(s: int, e: int) -> tuple[int, int]:
        return int(at[s]), int(at[e - 1]) + 1

    sentences, begun = [], 0
    for m in STOP.finditer(text):
        if _ends_no_sentence(text[max(0, m.start() - 12):m.start()]):
            continue
        sentences.append((begun, m.end()))
        begun = m.end()
    sentences.append((begun, len(text)))
    excluded = [(*raw_span(*m.span(1)), "quote") for p in QUOTES for m in p.finditer(text)]
    excluded += [(*raw_span(*m.span()), "citation") for m in CITED.finditer(text)]
    if (head := _references(text)) is not None:
        excluded.append((*raw_span(head, len(text)), "bibliography"))
    return Normalized(text, at, words, spans, [raw_span(s, e) for s, e in sentences if text[s:e].strip()], merged(excluded))


def stored_words(text: str) -> list[str]:
    return [w.lower() for w in TOKEN.findall(text)]


# --- fingerprints -------------------------------------------------------------------------------

P = np.uint64(PRIME)


def _reduce(x: np.ndarray) -> np.ndarray:
    x = (x & P) + (x >> np.uint64(61))
    return np.minimum(x, x - P)  # below P the difference wraps and is the larger


def _rotl(h: np.ndarray, n: int) -> np.ndarray:
    return ((h << np.uint64(n)) & P) | (h >> np.uint64(61 - n))


@functools.lru_cache(1 << 18)
def word_value(word: str) -> int:
    """The word's code points as digits of a number to base 31, modulo 2^61 - 1."""
    return functools.reduce(lambda h, c: (h * 31 + ord(c)) % PRIME, word, 0)


def fnv1a32(word: str) -> int:
    return functools.reduce(lambda h, c: (h ^ ord(c)) * 16777619 & 0xFFFFFFFF, word, 2166136261)


def shingles(words: list[str], k: int) -> np.ndarray:
    """Hash of every run of k words; base 257 is 2^8 + 1, so a step is a rotation and two sums."""
    n = len(words) - k + 1
    if k <= 0 or n <= 0:
        return np.empty(0, np.uint64)
    v = np.fromiter(map(word_value, words), np.uint64, len(words))
    h = v[:n].copy()
    for i in range(1, k):
        h = _reduce(_rotl(h, 8) + h + v[i:i + n])
    return h


def winnow(h: np.ndarray, w: int) -> np.ndarray:
    """Positions of the smallest hash of each window, the rightmost on ties; one window if there are fewer than w."""
    if w <= 0 or not len(h):
        return np.empty(0, np.int64)
    w = min(w, len(h))
    win = np.lib.stride_tricks.sliding_window_view(h, w)[:, ::-1]
    return np.unique(np.arange(len(win)) + w - 1 - win.argmin(axis=1))


@functools.cache
def permutations(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = random.Random(seed)
    pairs = [(rng.randrange(1, PRIME), rng.randrange(PRIME)) for _ in range(n)]
    return np.array([a for a, _ in pairs], np.uint64), np.array([b for _, b in pairs], np.uint64)


def mulmod(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2^61 - 1 in limbs of 29 and 32 bits."""
    lo29, s29, s32 = np.uint64((1 << 29) - 1), np.uint64(29), np.uint64(32)
    a1, a0 = a >> s32, a & np.uint64(0xFFFFFFFF)  # a = a1 2^32 + a0
    b1, b0 = b >> s29, b & lo29  # b = b1 2^29 + b0
    # 2^61 = 1: a1 b1 2^61 = a1 b1; the others are shifted round. All but a0 b1 are under 2^61, and so is each of the four terms
    return _reduce(a1 * b1 + _shift(a1 * b0, 32) + _shift(_reduce(_mul32(a0, b1)), 29) + a0 * b0)


def _shift(x: np.ndarray, n: int) -> np.ndarray:
    return _rotl(x, n)


def _mul32(a0: np.ndarray, b1: np.ndarray) -> np.ndarray:
    return a0 * b1  # both under 2^32


def minhash(values: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Signature of a set of values; the sentinel 2^61 - 1 in every slot if it is empty."""
    a, b = permutations(n, seed)
    if not len(values):
        return np.full(n, PRIME, np.int64)
    h = _reduce(mulmod(a[:, None], values.astype(np.uint64)[None, :]) + b[:, None])
    return h.min(axis=1).astype(np.int64)


def fingerprint(words: list[str], cfg: FingerprintConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, values, signature)."""
    h = shingles(words, cfg.k)
    pos = winnow(h, cfg.w)
    values = h[pos].astype(np.int64)
    return pos, values, minhash(np.unique(values), cfg.n_perm, cfg.seed)


# --- alignment ----------------------------------------------------------------------------------


def shared_positions(pos_a: np.ndarray, value_a: np.ndarray, pos_b: np.ndarray, value_b: np.ndarray) -> list[tuple[int, int]]:
    """(position in a, position in b) of every two equal values."""
    where: dict[int, list[int]] = {}
    for p, v in zip(pos_b.tolist(), value_b.tolist()):
        where.setdefault(v, []).append(p)
    return [(q, s) for q, v in zip(pos_a.tolist(), value_a.tolist()) for s in where.get(v, ())]


def chains(seeds: list[tuple[int, int]], gap: int) -> list[list[int]]:
    """[query start, query end, source start, source end, anchors]: a seed joins the first chain near its diagonal and its query end."""
    out: list[list[int]] = []
    live: list[list[int]] = []  # chains a later seed can still join: seeds come in query order
    for q, s in sorted(seeds):
        live = [c for c in live if q - c[1] <= gap]
        home = next((c for c in live if abs(q - s - c[0] + c[2]) <= gap), None)
        if home is None:
            home = [q, q, s, s, 0]
            out.append(home)
            live.append(home)
        home[1], home[2], home[3], home[4] = max(home[1], q), min(home[2], s), max(home[3], s), home[4] + 1
    return out


CELLS = 4_000_000  # of a batch's score matrices


def local_alignments(regions: list[tuple[np.ndarray, np.ndarray]], cfg: AlignConfig) -> list[tuple[int, int, int, int, float]]:
    """For each (a, b) the best local alignment: first and last in a, first and last in b, share of aligned places that match; (0, -1, 0, -1, 0.0) if none.

    Regions of like size are scored together, one row of all of them at a time. Scores are doubled to
    integers; the best way along a row is a running maximum of the scores with the gap cost taken
    out. What fills up a smaller region equals nothing, so scores only fall there.
    """
    out: list[tuple[int, int, int, int, float]] = [(0, -1, 0, -1, 0.0)] * len(regions)
    cells = [(len(a) + 1) * (len(b) + 1) if len(a) and len(b) else 0 for a, b in regions]
    for k in (k for k, c in enumerate(cells) if c > CELLS):
        out[k] = _score_long(*regions[k], cfg)
    order = sorted((k for k, c in enumerate(cells) if 0 < c <= CELLS), key=lambda k: (len(regions[k][0]), len(regions[k][1])))
    while order:
        n = m = size = 0
        while size < len(order):
            a, b = regions[order[size]]
            if size and (size + 1) * (max(n, len(a)) + 1) * (max(m, len(b)) + 1) > CELLS:
                break
            n, m, size = max(n, len(a)), max(m, len(b)), size + 1
        group, order = order[:size], order[size:]
        x, y = np.full((size, n), -1, np.int32), np.full((size, m), -2, np.int32)
        for r, k in enumerate(group):
            x[r, :len(regions[k][0])], y[r, :len(regions[k][1])] = regions[k]
        for k, found in zip(group, _score(x, y, cfg)):
            out[k] = found
    return out


def _score(x: np.ndarray, y: np.ndarray, cfg: AlignConfig) -> list[tuple[int, int, int, int, float]]:
    size, n, m = len(x), x.shape[1], y.shape[1]
    match, mismatch, gap = (round(2 * v) for v in (cfg.match, cfg.mismatch, cfg.gap))
    h = np.zeros((n + 1, size, m + 1), np.int32)
    slope = (gap * np.arange(m + 1)).astype(np.int32)
    for i in range(1, n + 1):
        row = h[i]
        np.maximum(h[i - 1, :, :-1] + np.where(y == x[:, i - 1, None], match, mismatch), h[i - 1, :, 1:] + gap, out=row[:, 1:])
        np.maximum(row, 0, out=row)
        row -= slope
        np.maximum.accumulate(row, axis=1, out=row)
        row += slope
    r = np.arange(size)
    by_row = h.max(axis=2)  # (n + 1, size)
    i = by_row.argmax(axis=0)  # the first of the best, row by row
    j = h[i, r].argmax(axis=1)
    ends = i - 1, j - 1
    best = h[i, r, j] > 0
    places, hits = np.zeros(size, int), np.zeros(size, int)
    live = best.copy()
    while live.any():
        k = np.flatnonzero(live)
        a, b = i[k], j[k]
        now = h[a, k, b]
        same = x[k, a - 1] == y[k, b - 1]
        diagonal = now == h[a - 1, k, b - 1] + np.where(same, match, mismatch)
        up = ~diagonal & (now == h[a - 1, k, b] + gap)
        places[k] += 1
        hits[k] += diagonal & same
        i[k] -= diagonal | up
        j[k] -= ~up
        live[k] = (i[k] > 0) & (j[k] > 0) & (h[i[k], k, j[k]] > 0)
    return [(int(i[k]), int(ends[0][k]), int(j[k]), int(ends[1][k]), hits[k] / places[k]) if best[k] else (0, -1, 0, -1, 0.0) for k in r]


def _score_long(a: np.ndarray, b: np.ndarray, cfg: AlignConfig) -> tuple[int, int, int, int, float]:
    """As _score() for one region whose matrix would be too large: every so many rows one is kept, and those between are made again on the way back."""
    n, m = len(a), len(b)
    match, mismatch, gap = (round(2 * v) for v in (cfg.match, cfg.mismatch, cfg.gap))
    slope = (gap * np.arange(m + 1)).astype(np.int32)

    def after(row: np.ndarray, i: int) -> np.ndarray:
        new = np.zeros(m + 1, np.int32)
        np.maximum(row[:-1] + np.where(b == a[i - 1], match, mismatch), row[1:] + gap, out=new[1:])
        np.maximum(new, 0, out=new)
        return np.maximum.accumulate(new - slope) + slope

    step = int(n**0.5) + 1
    kept = {0: np.zeros(m + 1, np.int32)}
    row, best, i, j = kept[0], 0, 0, 0
    for r in range(1, n + 1):
        row = after(row, r).astype(np.int32)
        if (top := int(row.max())) > best:
            best, i, j = top, r, int(row.argmax())
        if r % step == 0:
            kept[r] = row
    if not best:
        return 0, -1, 0, -1, 0.0
    ends = i - 1, j - 1
    places = hits = 0
    while i and j:
        base = (i - 1) // step * step
        block = [kept[base]]
        for r in range(base + 1, i + 1):
            block.append(after(block[-1], r).astype(np.int32))
        while i > base and j and block[i - base][j]:
            now, above = block[i - base][j], block[i - base - 1]
            places += 1
            same = a[i - 1] == b[j - 1]
            if now == above[j - 1] + (match if same else mismatch):
                hits += int(same)
                i, j = i - 1, j - 1
            elif now == above[j] + gap:
                i -= 1
            else:
                j -= 1
        if not j or not block[i - base][j]:
            break
    return i, ends[0], j, ends[1], hits / places


def smith_waterman(a: np.ndarray, b: np.ndarray, cfg: AlignConfig) -> tuple[int, int, int, int, float]:
    return local_alignments([(a, b)], cfg)[0]


def merge_claims(found: list[tuple], share: float = 0.5) -> list[tuple]:
    """Of passages (q0, q1, s0, s1, identity) of one source, the longest and best first; one mostly claimed before is dropped."""
    kept: list[tuple] = []
    for p in sorted(found, key=lambda p: (p[0] - p[1], -p[4])):
        taken = sum(max(0, min(p[1], k[1]) - max(p[0], k[0]) + 1) for k in kept)
        if taken <= share * (p[1] - p[0] + 1):
            kept.append(p)
    return sorted(kept, key=lambda p: (p[0], p[0] - p[1]))


def align(pairs: list[tuple[list[str], list[str], list[tuple[int, int]]]], k: int, cfg: AlignConfig) -> list[list[tuple]]:
    """For each (query words, source words, seeds) its passages (q0, q1, s0, s1, identity), token positions inclusive."""
    regions, where = [], []
    for no, (query, source, seeds) in enumerate(pairs):
        code: dict[str, int] = {}
        a = np.array([code.setdefault(w, len(code)) for w in query], np.int32)
        b = np.array([code.setdefault(w, len(code)) for w in source], np.int32)
        for q0, q1, s0, s1, _ in chains(seeds, cfg.max_gap):
            qa, sa = max(0, q0 - cfg.pad), max(0, s0 - cfg.pad)
            regions.append((a[qa:q1 + k + cfg.pad], b[sa:s1 + k + cfg.pad]))
            where.append((no, qa, sa))
    found: list[list[tuple]] = [[] for _ in pairs]
    for (no, qa, sa), (x, y, u, v, same) in zip(where, local_alignments(regions, cfg)):
        if y - x + 1 >= max(1, cfg.min_words):
            found[no].append((qa + x, qa + y, sa + u, sa + v, same))
    return [merge_claims(f) for f in found]


# --- features -----------------------------------------------------------------------------------


def entropy(counts: list[int]) -> float:
    c = np.array([x for x in counts if x > 0], float)
    if not len(c):
        return 0.0
    p = c / c.sum()
    return float(-(p * np.log2(p)).sum()) + 0.0


def style(doc: Normalized) -> dict[str, float]:
    """The seven style features of a normalized text; all zero without words."""
    names = ("sent_len_mean", "sent_len_cv", "type_token_ratio", "hapax_ratio", "function_word_ratio", "punct_entropy", "discourse_marker_rate")
    n = len(doc.words)
    if not n:
        return dict.fromkeys(names, 0.0)
    starts = np.array([s for s, _ in doc.spans])
    size = np.array([np.searchsorted(starts, e) - np.searchsorted(starts, s) for s, e in doc.sentences], float)
    size = size[size > 0]
    mean = float(size.mean()) if len(size) else 0.0
    count = Counter(doc.words)
    marks = Counter(c for c in doc.text if not c.isalnum() and not c.isspace())
    return dict(zip(names, (
        mean, float(size.std()) / mean if mean else 0.0, len(count) / n, sum(x == 1 for x in count.values()) / n,
        sum(x for w, x in count.items() if w in FUNCTION_WORDS) / n, entropy(list(marks.values())),
        sum(x for w, x in count.items() if w in DISCOURSE_MARKERS) / n), strict=True))


def query_phrases(words: list[str], count: int = 6, size: int = 6) -> list[str]:
    """Up to `count` windows that do not overlap, those with most content words first, in the order of the text."""
    if len(words) <= size:
        return [" ".join(words)] if words else []
    content = np.array([len(w) > 3 and w not in QUERY_STOPWORDS for w in words], int)
    score = np.convolve(content, np.ones(size, int), "valid")
    free = np.ones(len(score), bool)
    taken: list[int] = []
    for s in np.argsort(-score, kind="stable"):
        if free[s]:
            taken.append(int(s))
            free[max(0, s - size + 1):s + size] = False
            if len(taken) >= count:
                break
    return [" ".join(words[s:s + size]) for s in sorted(taken)]


def isotonic_fit(scores: list[float], labels: list[float]) -> tuple[list[float], list[float]]:
    """Pool adjacent violators: (right ends of the steps, their values), values never falling."""
    ends: list[float] = []
    sums: list[float] = []
    sizes: list[float] = []
    for s, y in sorted(zip(scores, labels, strict=True)):
        ends.append(s); sums.append(float(y)); sizes.append(1.0)
        while len(ends) > 1 and sums[-2] / sizes[-2] > sums[-1] / sizes[-1]:
            e, t, z = ends.pop(), sums.pop(), sizes.pop()
            ends[-1], sums[-1], sizes[-1] = max(ends[-1], e), sums[-1] + t, sizes[-1] + z
    return ends, [a / b for a, b in zip(sums, sizes, strict=True)]


# --- language models ------------------------------------------------------------------------------


def mask_spans(text: str, rate: float = 0.15, size: int = 2, seed: int = 0) -> tuple[str, int]:
    """(text with some spans of words replaced by numbered sentinels, how many)."""
    words = text.split()
    if len(words) <= size:
        return text, 0
    slots = range(0, len(words) - size + 1, size)
    wanted = min(max(1, int(len(words) * rate / size)), len(slots))
    chosen = sorted(random.Random(seed).sample(list(slots), wanted))
    out, at = [], 0
    for i, s in enumerate(chosen):
        out += [*words[at:s], f"<extra_id_{i}>"]
        at = s + size
    return " ".join(out + words[at:]), len(chosen)


SENTINEL = re.compile(r"<extra_id_(\d+)>")


def refill(masked: str, generated: str) -> str:
    """Sentinels replaced by the generated fragments that follow theirs; those without one vanish."""
    marks = list(SENTINEL.finditer(generated))
    ends = [m.start() for m in marks[1:]] + [len(generated)]
    parts = {m[1]: generated[m.end():e].strip() for m, e in zip(marks, ends, strict=True)}
    return " ".join(SENTINEL.sub(lambda m: parts.get(m[1], ""), masked).split())


def drop_words(text: str, n: int = 8, rate: float = 0.15, seed: int = 7) -> list[str]:
    """Variants of a text of 20 words or more with some words left out; variants of 10 words or fewer are dropped."""
    words = text.split()
    if len(words) < 20:
        return []
    rng = random.Random(seed)
    kept = [[w for w in words if rng.random() > rate] for _ in range(n)]
    return [" ".join(k) for k in kept if len(k) > 10]


def likelihood(text: str, model, sentences: list[tuple[int, int]]) -> dict[str, float] | None:
    """The five likelihood features, or None where the model gives nothing. `model` has token_logprobs(text) and perturb(text)."""
    triples = model.token_logprobs(text)
    if not triples:
        return None
    logp = np.array([t[1] for t in triples])

    def mean_logp(s: str) -> float | None:
        t = model.token_logprobs(s)
        return float(np.mean([x[1] for x in t])) if t else None

    per = [m for s, e in sentences if len(text[s:e].split()) >= 4 and (m := mean_logp(text[s:e])) is not None]
    drops = [logp.mean() - m for v in model.perturb(text) if (m := mean_logp(v)) is not None]
    spread = float(np.std(drops)) if drops else 0.0
    return {
        "mean_log_prob": float(logp.mean()), "log_prob_std": float(logp.std()), "burstiness": float(np.std(per)) if len(per) >= 2 else 0.0,
        "mean_log_rank": float(np.mean([t[2] for t in triples])), "curvature": float(np.mean(drops)) / (spread or 1.0) if drops else 0.0,
    }


# --- ingest and report ------------------------------------------------------------------------------


def decode(data: bytes) -> str:
    """UTF-8, then UTF-16, then Windows-1252, then Latin-1, which always succeeds."""
    for name in ("utf-8", "utf-16", "cp1252"):
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            pass
    return data.decode("latin-1")


def docx_text(data: bytes) -> str:
    """Paragraphs, then the rows of all tables with tabs between their cells."""
    import io
    import zipfile
    from xml.etree import ElementTree

    ns = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{ns}body")

    def text(e) -> str:
        return "".join("\t" if x.tag == f"{ns}tab" else "\n" if x.tag in (f"{ns}br", f"{ns}cr") else x.text or "" if x.tag == f"{ns}t" else "" for x in e.iter())

    blocks = [text(p) for p in body.findall(f"{ns}p")]
    for row in body.iterfind(f"{ns}tbl/{ns}tr"):
        blocks.append("\t".join("\n".join(text(p) for p in cell.findall(f"{ns}p")) for cell in row.findall(f"{ns}tc")))
    return "\n".join(blocks)


RTF = re.compile(r"\\'([0-9a-fA-F]{2})|\\u(-?\d+) ?\??|\\([a-z]+)(-?\d+)? ?|\\([^a-z])|([{}])|\r?\n|([^\\{}\r\n]+)", re.I)
# Destinations whose content is not text.
RTF_SKIP = frozenset("fonttbl colortbl stylesheet info pict header footer footnote themedata colorschememapping datastore latentstyles generator listtable listoverridetable rsidtbl xmlnstbl".split())


def rtf_text(text: str) -> str:
    out: list[str] = []
    stack: list[bool] = []
    skip = False
    for m in RTF.finditer(text):
        code, uni, word, _, sign, brace, plain = m.groups()
        if brace == "{":
            stack.append(skip)
        elif brace == "}":
            skip = stack.pop() if stack else False
        elif sign == "*" or word and word.lower() in RTF_SKIP:
            skip = True
        elif skip:
            continue
        elif code:
            out.append(bytes.fromhex(code).decode("cp1252", "replace"))
        elif uni:
            out.append(chr(int(uni) % 65536))
        elif word:
            out.append({"par": "\n", "line": "\n", "tab": "\t", "emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "bullet": "•"}.get(word.lower(), ""))
        elif sign:
            out.append({"~": "\u00a0", "_": "-", "-": ""}.get(sign, sign))
        elif plain:
            out.append(plain)
    return "".join(out)


def pdf_text(data: bytes) -> tuple[str, list[int]]:
    """Text of the pages, one line break between them, and where each begins; needs pypdf."""
    import io

    from pypdf import PdfReader

    pages = [p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages]
    starts = [0, *np.cumsum([len(p) + 1 for p in pages[:-1]]).tolist()] if pages else []
    return "\n".join(pages), starts


def html_text(text: str) -> str:
    """Text of an HTML page without scripts, styles, navigation and footer; needs bs4, else tags become blanks."""
    try:
        from bs4 import BeautifulSoup
    except ImportError:
        return re.sub(r"<[^>]+>", " ", re.sub(r"(?is)<(script|style)\b.*?</\1>", " ", text))
    soup = BeautifulSoup(text, "html.parser")
    for t in soup(["script", "style", "nav", "footer"]):
        t.decompose()
    return soup.get_text("\n")


def highlight(text: str, marks: list[tuple[int, int, str, str]]) -> str:
    """HTML of a text with (start, end, class, title) marked, left to right; a mark that begins inside another is left out."""
    out, at = [], 0
    for s, e, kind, title in sorted(marks):
        if s < at:
            continue
        s, e = min(max(s, 0), len(text)), min(max(e, s), len(text))
        out += [html.escape(text[at:s]), f'<mark class="{kind}" title="{html.escape(title)}">{html.escape(text[s:e])}</mark>']
        at = e
    return ("".join(out) + html.escape(text[at:])).replace("\n", "<br>\n")
