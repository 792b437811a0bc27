"""Plain definitions of the sampling operators, base by base."""

CODE = {"A": 0, "C": 1, "G": 2, "T": 3}
M32 = (1 << 32) - 1


def hash32(x):
    x ^= x >> 13
    x = x * 0x85EBCA6B & M32
    return x ^ x >> 16


def code(seq):
    return sum(CODE[c] << 2 * j for j, c in enumerate(seq))


def rc(seq):
    return seq[::-1].translate(str.maketrans("ACGT", "TGCA"))


def kmer_hash(seq, p, k, canonical):
    s = seq[p : p + min(k, 16)]
    return hash32(min(code(s), code(rc(s))) if canonical else code(s))


def minimizers(seq, k, w, canonical=True):
    h = [kmer_hash(seq, p, k, canonical) for p in range(len(seq) - k + 1)]
    out = []
    for i in range(len(h) - w + 1):
        _, p = min((h[j] >> 8, j) for j in range(i, i + w))
        if not out or out[-1][0] != p:
            out.append((p, h[p] >> 8 << 8))
    return out


def syncmers(seq, k, s, t=0, closed=True, strict=False, canonical=True):
    w = k - s + 1
    h = [kmer_hash(seq, p, s, canonical) for p in range(len(seq) - s + 1)]
    out = []
    for i in range(len(seq) - k + 1):
        x = h[i : i + w]
        m = min(x)
        if strict:
            hit = x.index(m) == w // 2
        else:
            hit = x[t] == m or closed and x[-1] == m
        if hit:
            out.append(i)
    return out


def mix64(c):
    c ^= c >> 33
    c = c * 0xFF51AFD7ED558CCD & (1 << 64) - 1
    return c ^ c >> 33


def masked_hash(x, k):
    m = (1 << 2 * k) - 1
    x = (~x + (x << 21)) & m
    x ^= x >> 24
    x = (x + (x << 3) + (x << 8)) & m
    x ^= x >> 14
    x = (x + (x << 2) + (x << 4)) & m
    x ^= x >> 28
    return (x + (x << 31)) & m
