"""Sketching kernels on Arrow batches of nucleotide strings.

A batch's sequences are laid end to end as 2-bit codes and treated at once; places where a window
would cross into the next sequence are masked out. Nothing depends on the batch a sequence is in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_CODE = np.zeros(256, np.uint8)
for _i, _c in enumerate("ACGT"):
    _CODE[ord(_c)] = _CODE[ord(_c.lower())] = _i


def sequences(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """2-bit codes of all strings end to end, and their offsets."""
    if col.null_count:
        col = col.fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and len(col) else np.zeros(0, np.uint8)
    return _CODE[raw], off - (off[0] if len(off) else 0)


def fits(off: np.ndarray, n: int, span: int) -> np.ndarray:
    """Which of the first n places begin a stretch of ``span`` bases within one sequence."""
    ok = np.zeros(max(n, 0), bool)
    if n > 0:
        last = np.repeat(off[1:], np.diff(off))[:n]
        ok = np.arange(n) + span <= last
    return ok


def packed(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Little-endian codes of all k-mers (k <= 32) and of their reverse complements."""
    n = len(codes) - k + 1
    fwd, rev = np.zeros(max(n, 0), np.uint64), np.zeros(max(n, 0), np.uint64)
    if n > 0:
        c = codes.astype(np.uint64)
        for j in range(k):
            fwd |= c[j : j + n] << np.uint64(2 * j)
            rev |= (np.uint64(3) - c[j : j + n]) << np.uint64(2 * (k - 1 - j))
    return fwd, rev


def big_endian(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Big-endian codes of all k-mers and of their reverse complements."""
    n = len(codes) - k + 1
    fwd, rev = np.zeros(max(n, 0), np.uint64), np.zeros(max(n, 0), np.uint64)
    if n > 0:
        c = codes.astype(np.uint64)
        for j in range(k):
            fwd = (fwd << np.uint64(2)) | c[j : j + n]
            rev |= (np.uint64(3) - c[j : j + n]) << np.uint64(2 * j)
    return fwd, rev


def hash32(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint32)
    x = x ^ (x >> np.uint32(13))
    x = x * np.uint32(0x85EBCA6B)
    return x ^ (x >> np.uint32(16))


def round64(x: np.ndarray) -> np.ndarray:
    """One round of 64-bit mixing."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


def masked64(x: np.ndarray, k: int) -> np.ndarray:
    """The invertible hash of 2k-bit keys."""
    m = np.uint64((1 << 2 * k) - 1)
    s = np.uint64
    x = (~x + (x << s(21))) & m
    x = x ^ (x >> s(24))
    x = (x + (x << s(3)) + (x << s(8))) & m
    x = x ^ (x >> s(14))
    x = (x + (x << s(2)) + (x << s(4))) & m
    x = x ^ (x >> s(28))
    return (x + (x << s(31))) & m


def kmer_hashes(codes: np.ndarray, k: int, canonical: bool) -> np.ndarray:
    """32-bit hashes of all k-mers; of longer ones the first 16 bases count."""
    fwd, rev = packed(codes, min(k, 16))
    x = np.minimum(fwd, rev) if canonical else fwd
    return hash32(x)[: max(len(codes) - k + 1, 0)]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minima of all windows of w values, by doubling."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    size, m = 1, x
    while size * 2 <= w:
        m = np.minimum(m[: len(m) - size], m[size:])
        size *= 2
    return np.minimum(m[:n], m[w - size : w - size + n])


def minimizer_places(codes, off, k: int, w: int, canonical: bool = True, block: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes: of each window the leftmost least by the top 24 bits, when it changes.

    With ``block``, windows that begin in a sequence's last block are left out.
    """
    h = kmer_hashes(codes, k, canonical)
    key = ((h >> np.uint32(8)).astype(np.uint64) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
    m = sliding_min(key, w)
    ok = fits(off, len(m), k + w - 1)
    if block:
        size = np.diff(off)
        whole = np.maximum(0, -(-size // block) - 1) * block
        ok &= (np.arange(len(m)) - np.repeat(off[:-1], size)[: len(m)]) < np.repeat(whole, size)[: len(m)]
    best = (m[ok] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    keep = np.ones(len(best), bool)
    keep[1:] = best[1:] != best[:-1]
    best = best[keep]
    return best, (h[best] >> np.uint32(8)) << np.uint32(8)


def syncmer_places(codes, off, k: int, s: int, t: int = 0, closed: bool = True, strict: bool = False, canonical: bool = True) -> np.ndarray:
    """Begins of the k-mers whose least s-mer hash is where it has to be (ties count, unless strict)."""
    if s > 16:
        raise ValueError("s-mers have at most 16 bases")
    w = k - s + 1
    h = kmer_hashes(codes, s, canonical)
    if strict:
        key = (h.astype(np.uint64) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
        m = sliding_min(key, w)
        hit = (m & np.uint64(0xFFFFFFFF)).astype(np.int64) - np.arange(len(m)) == w // 2
    else:
        m = sliding_min(h, w)
        n = len(m)
        hit = h[t : t + n] == m
        if closed:
            hit |= h[w - 1 : w - 1 + n] == m
    return np.flatnonzero(hit & fits(off, len(m), k))


def harvested(codes, at: np.ndarray, k: int, canonical: bool = True, mixed: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """k-mers (k <= 32) at places, by default canonical and mixed; and whether the reverse one is the less."""
    x, rev = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    c = codes.astype(np.uint64)
    for j in range(k):
        b = c[at + j]
        x |= b << np.uint64(2 * j)
        rev |= (np.uint64(3) - b) << np.uint64(2 * (k - 1 - j))
    strand = rev < x
    if canonical:
        x = np.minimum(x, rev)
    return (round64(x) if mixed else x), strand


def native_sketch(seq: str, w: int, k: int, compressed: bool = False) -> list[tuple[int, int, int, int]]:
    """(key, span, last base, strand) of a sequence's strand-aware minimizers.

    Windows hold w k-mers that are not their own reverse complement, in the order they end; all
    k-mers that share a window's least hash are minimizers. Other letters than bases break k-mers but
    not windows. With ``compressed``, a run of one base counts as one and spans the run.
    """
    if not compressed and k % 2:
        key, at, strand = block_sketch(seq.encode(), w, k, 0, len(seq), True)
        return list(zip(key.tolist(), [k] * len(key), at.tolist(), strand.tolist()))
    if not compressed and seq and not set(seq) - set("ACGTacgt"):
        return _plain_sketch(seq, w, k)
    return _stepwise_sketch(seq, w, k, compressed)


_BASE = np.full(256, 4, np.uint8)
for _i, _c in enumerate("ACGT"):
    _BASE[ord(_c)] = _BASE[ord(_c.lower())] = _i
_BASE[ord("U")] = _BASE[ord("u")] = 3


def block_sketch(text: bytes, w: int, k: int, low: int, high: int, ends: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, last base, strand) of minimizers whose last base is in [low, high) of a piece of a sequence; k is odd.

    An odd k-mer is never its own reverse complement, so windows hold w neighbouring k-mers, and what is a minimizer depends on
    w + k - 2 letters before its last base and w - 1 after it. A piece that holds these tells its own; with ``ends`` it
    reaches the sequence's end, whose last w letters have a minimizer though no window may be full there.
    """
    key, _, at, strand = block_sketches([text], w, k, np.array([low]), np.array([high]), np.array([ends]))
    return key, at, strand


def block_sketches(texts: list[bytes], w: int, k: int, low: np.ndarray, high: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``block_sketch`` of many pieces at once: (key, piece, last base, strand). A letter between them that is no base parts
    their windows, as full windows hold bases only."""
    size = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(size + 1) - size - 1
    base = _BASE[np.frombuffer(b"#".join(texts), np.uint8)]
    if len(base) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    place = np.arange(len(base))
    run = place - np.maximum.accumulate(np.where(base > 3, place, -1))  # bases in a row up to here
    fwd, rev = big_endian(base & 3, k)
    run = run[k - 1 :]
    known = run >= k
    x = np.where(known, masked64(np.minimum(fwd, rev), k), ~np.uint64(0))
    keep = np.zeros(len(x), bool)
    if len(x) >= w:
        full = run[w - 1 :] >= w + k - 1
        side = np.zeros(w - 1, np.uint64)
        least = np.concatenate([side, np.where(full, sliding_min(x, w), np.uint64(0)), side])
        count = np.concatenate([[0], np.cumsum(np.concatenate([side.astype(bool), full, side.astype(bool)]))])
        keep = known & (count[w:] > count[:-w]) & (~sliding_min(~least, w) == x)
    some = ends & (size >= k)
    at = (begin + size - k)[some, None] - np.arange(w)  # the last w k-mers, from the end
    inside = at >= begin[some, None]
    at = np.maximum(at, 0)
    last = at[np.arange(len(at)), np.argmin(np.where(inside, x[at], ~np.uint64(0)), axis=1)]
    keep[last[(inside & known[at]).any(1)]] = True
    at = np.flatnonzero(keep)
    piece = np.searchsorted(begin, at, "right") - 1
    pos = at - begin[piece] + k - 1
    own = (pos >= low[piece]) & (pos < high[piece])
    at = at[own]
    return x[at], piece[own], pos[own], (fwd[at] > rev[at]).astype(np.int32)


def _plain_sketch(seq: str, w: int, k: int) -> list[tuple[int, int, int, int]]:
    """Bases only: an entry is a minimizer if the greatest minimum of the windows that hold it is its own."""
    codes = _CODE[np.frombuffer(seq.encode(), np.uint8)]
    fwd, rev = big_endian(codes, k)
    at = np.flatnonzero(fwd != rev)
    if not len(at):
        return []
    strand = (fwd > rev)[at]
    x = masked64(np.minimum(fwd, rev)[at], k)
    m = sliding_min(x, w)
    if len(m):
        padded = np.concatenate([np.zeros(w - 1, np.uint64), m, np.zeros(w - 1, np.uint64)])
        most = ~sliding_min(~padded, w)
        keep = np.flatnonzero(most == x)
    else:
        keep = np.array([len(x) - 1 - int(np.argmin(x[::-1]))])
    return list(zip(x[keep].tolist(), [k] * len(keep), (at[keep] + k - 1).tolist(), strand[keep].astype(int).tolist()))


def _stepwise_sketch(seq: str, w: int, k: int, compressed: bool) -> list[tuple[int, int, int, int]]:
    mask, top = (1 << 2 * k) - 1, 2 * (k - 1)
    code = {"A": 0, "C": 1, "G": 2, "T": 3, "U": 3, "a": 0, "c": 1, "g": 2, "t": 3, "u": 3}
    fwd = rev = have = 0
    runs: list[int] = []
    entries: list[tuple[int, int, int, int] | None] = []
    i, n = 0, len(seq)
    breaks: list[int] = []
    filled: list[int] = []
    while i < n:
        c = code.get(seq[i])
        if c is None:
            have, runs = 0, []
            entries.append(None)
            filled.append(0)
            i += 1
            continue
        length = 1
        if compressed:
            while i + length < n and code.get(seq[i + length]) == c:
                length += 1
            i += length - 1
        runs.append(length)
        if len(runs) > k:
            runs.pop(0)
        fwd, rev = ((fwd << 2) | c) & mask, (rev >> 2) | ((3 - c) << top)
        if fwd != rev:
            have += 1
            span = sum(runs)
            if have >= k and span < 256:
                z = int(fwd > rev)
                key = int(masked64(np.array([rev if z else fwd], np.uint64), k)[0])
                entries.append((key, span, i, z))
            else:
                entries.append(None)
            filled.append(have)
        i += 1
    return _least_of_windows(entries, filled, w, k)


def _least_of_windows(entries, filled, w: int, k: int):
    """All entries that are least in a full window; the least of what never fills a window."""
    out, done = [], set()

    def emit(i):
        if i not in done:
            done.add(i)
            out.append(entries[i])

    best = None
    for i, e in enumerate(entries):
        low = max(0, i - w + 1)
        if e is not None and (best is None or (e[0], e[1]) <= (entries[best][0], entries[best][1])):
            best = i
        elif best is not None and best < low:
            live = [j for j in range(low, i + 1) if entries[j] is not None]
            best = max(live, key=lambda j: (-entries[j][0], -entries[j][1], j)) if live else None
        if filled[i] >= w + k - 1 and best is not None:
            least = entries[best][:2]
            for j in range(low, i + 1):
                if entries[j] is not None and entries[j][:2] == least:
                    emit(j)
    if best is not None:
        emit(best)
    return sorted(out, key=lambda e: e[2])


def dust(seq: str, threshold: int = 20, window: int = 64) -> list[tuple[int, int]]:
    """Low-complexity stretches [start, end): those in windows whose triplet score exceeds the threshold
    and that no part exceeds (symmetric DUST, scores times ten), joined where they touch."""
    code = {"A": 0, "C": 1, "G": 2, "T": 3}
    out: list[tuple[int, int]] = []
    start = 0
    for part in _runs_of_bases(seq.upper()):
        start, text = part
        t = [code[text[i]] * 16 + code[text[i + 1]] * 4 + code[text[i + 2]] for i in range(len(text) - 2)]
        perfect: dict[tuple[int, int], float] = {}
        most = window - 2
        for end in range(len(t)):
            count: dict[int, int] = {}
            pairs, best = 0, 0.0
            for begin in range(end, max(-1, end - most), -1):
                c = count.get(t[begin], 0)
                pairs += c
                count[t[begin]] = c + 1
                size = end - begin + 1
                if size < 2:
                    continue
                score = pairs / (size - 1)
                if pairs * 10 > threshold * (size - 1) and score >= best:
                    inner = max((s for (a, b), s in perfect.items() if a >= begin and b <= end), default=0.0)
                    if score >= inner:
                        perfect[(begin, end)] = score
                best = max(best, score)
            for key in [p for p in perfect if p[0] < end - most]:
                out.append((start + key[0], start + key[1] + 3))
                del perfect[key]
        out += [(start + a, start + b + 3) for a, b in perfect]
    merged: list[tuple[int, int]] = []
    for a, b in sorted(out):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def _runs_of_bases(seq: str) -> Iterator[tuple[int, str]]:
    start = None
    for i, c in enumerate(seq + "#"):
        if c in "ACGT":
            start = i if start is None else start
        elif start is not None:
            yield start, seq[start:i]
            start = None
