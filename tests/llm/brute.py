"""Plain definitions of what the corpus operators return."""

import hashlib
import re
from collections import Counter

import numpy as np


def words(text):
    return (text or "").encode().lower().split()


def shingles(text, k=5):
    w = words(text)
    if len(w) >= k:
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    return {tuple(w)} if w else set()


def components(texts, percent=75):
    """doc_id -> smallest reachable one; all pairs are compared."""
    sets = {i: shingles(t) for i, t in texts.items()}
    up = {i: i for i in texts}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = root(a), root(b)
                    up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}, {i: len(s) for i, s in sets.items()}


BASE = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (2 if k % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def personal(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text):
            d = re.sub(r"[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (12 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), rank, kind, m.end()))
    return [(a, e, k) for a, _, k, e in sorted(out)]


def sha(text):
    return hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", text or "").encode()).hexdigest()


def unigram(texts, train):
    tokens = {i: [*words(t), None] for i, t in texts.items()}
    c = Counter(w for i in tokens if train(i) for w in tokens[i])
    n, v = c.total(), len(c)
    return {i: (len(t), sum(c[w] > 0 for w in t), sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)) for i, t in tokens.items()}, n


def targets(sizes, weights=(5, 2, 1), cap=3):
    """Clamp and reshare until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, clamped = sum(sizes.values()), set()
    while True:
        left = total - sum(cap * sizes[s] for s in clamped)
        open_ = [s for s in order if s not in clamped]
        t = {s: w[s] * left / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if t[s] > cap * sizes[s]]
        if not over:
            return {**{s: float(cap * sizes[s]) for s in clamped}, **t}
        clamped.update(over)
