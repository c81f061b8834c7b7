"""Plain versions of the operators' definitions, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction


def words(text):
    return (text or "").encode().split()


def folded(text):
    return (text or "").encode().lower().split()


def crc(key):
    return zlib.crc32(str("" if key is None else key).encode())


def shingles(text, n):
    w = folded(text)
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < n else [tuple(w[i:i + n]) for i in range(len(w) - n + 1)])


def jaccard_components(rows, n, percent):
    """rows: (id, text) -> per row (id, set size, smallest id reachable)."""
    sets = [shingles(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    tried = set()
    for i, s in enumerate(sets):
        for j in {j for x in s for j in holders[x] if j > i} - tried:
            both = len(s & sets[j])
            if 100 * both >= percent * len(s | sets[j]):
                parent[find(j)] = find(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return [(d, len(s), least.get(find(i), d)) for i, ((d, _), s) in
            enumerate(zip(rows, sets, strict=True))]


def mix_targets(sizes, weights=(3, 1, 2)):
    """sizes: source -> words; exact targets by resharing the excess until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, target = Fraction(3, 2) * sum(sizes.values()), {}
    open_ = list(names)
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 2 * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = Fraction(2 * sizes[s])
            left -= target[s]
            open_.remove(s)
    return target


def rule_counts(text):
    text = text or ""
    w = words(text)
    seen = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    inside = {k for i in range(len(w) - 7) if seen[tuple(w[i:i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    return (len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text),
            len(lines) - len(set(lines)), len(inside))


def unigram(rows, held_out):
    """rows: (id, text) -> per row (n_tokens, n_known, train tokens, base score)."""
    counts, ends = Counter(), 0
    for d, t in rows:
        if not held_out(d):
            counts.update(folded(t))
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + (ends > 0)
    out = []
    for _, t in rows:
        w = folded(t)
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)
        out.append((len(w) + 1, sum(counts[x] > 0 for x in w) + (ends > 0), n,
                    base + math.log10((ends + 1) / (n + v + 1))))
    return out


def planted(text, key):
    """The words of a text; every tenth document ends in a period that follows from its id."""
    w, h = words(text), crc(key)
    if h % 10 or not w:
        return w
    g = h // 10
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]


def runs(w, least=12):
    """(start, length, period) of every run, each lag walked from end to end."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(least, 2 * q):
                found.setdefault((s, i - s + q), q)
            i += 1
    return sorted((s, n, q) for (s, n), q in found.items())


def run_row(text, key):
    w = planted(text, key)
    found = runs(w)
    drop = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    kept = b" ".join(x for i, x in enumerate(w) if i not in drop)
    return (len(found), *(best or (None, None, None)), best and 1000 * best[1] // best[2],
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def collocations(rows, least, top=2000, inside=80):
    """rows: (lang, text) -> the report of phrases, every phrase counted as a tuple of words."""
    counts = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split(rb"[.,;:!?\x0a-\x0d]", (text or "").encode().lower()):
            w = [x for x in re.split(rb"[ \t]+", piece) if x]
            for k in range(1, 5):
                counts["und" if lang is None else lang].update(
                    tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        often = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        drop = {p[i:i + k] for p, c in often.items() for k in range(2, len(p))
                for i in range(len(p) - k + 1) if 100 * c >= inside * f[p[i:i + k]]}
        found = []
        for p, a in often.items():
            if p not in drop:
                score, cut = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k)
                                 for k in range(1, len(p)))
                found.append((-score, -a, b" ".join(p), f[p[:cut]], f[p[cut:]]))
        out += [(lang, i + 1, phrase.decode(), -a, left, right, n, -s)
                for i, (s, a, phrase, left, right) in enumerate(sorted(found)[:top])]
    return out
