"""What the corpus operators share: scratch tables, checked broadcasts, word hashing."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, scratch_dir  # noqa: F401

#: ASCII white space, as the contracts of the operators state it, and a word.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: A side with at most this many rows of a few numbers each may be broadcast.
BROADCAST_ROWS = 200_000

def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a (written, narrow) table is small enough to broadcast."""
    return df.limit(rows + 1).count() <= rows


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast behind a check of the size; else AQE's skew join has it."""
    return F.broadcast(df) if bounded(df, rows) else df


def drop_ids(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs without the ids of ``gone`` (one column); texts move only if the list is long."""
    gone = cut(gone.distinct())
    return docs.join(maybe_broadcast(gone, 2_000_000), id_col, "left_anti")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


_libc = ctypes.CDLL(None)


def release() -> None:
    """Give freed memory back to the system: Python workers outlive tasks, and an executor's memory has a limit."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


# ---------------------------------------------------------------- word hashing

_M = np.uint64(0xFFFFFFFFFFFFFFFF)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Texts are hashed in runs of about so many bytes; one longer text is a run of its own.
RUN_BYTES = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _pow(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, RUN_BYTES * 2)
        for k, b in enumerate((_BASE, _BASE_INV)):
            a = np.full(size, b, np.uint64)
            a[0] = 1
            _powers[k] = np.multiply.accumulate(a)
    return _powers


def runs(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive texts of an Arrow string column: first, last, bytes, offsets within them."""
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, kind)[col.offset : col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + RUN_BYTES, "right")) - 1)
        yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def word_spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begins and ends of the words of a run, and where each text's words begin (one more at the end).

    Words are the maximal stretches of bytes other than ASCII white space within a text.
    """
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(off), np.int64)
    space = _IS_SPACE[raw]
    word = ~space
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    begins = word.copy()
    begins[1:] &= space[:-1] | edge[1:n]
    ends = word
    ends[:-1] &= space[1:] | edge[1:n]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(s, off)


def hash_words(raw: np.ndarray, off: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of a run (A-Z lower-cased), and where each text's words begin."""
    s, e, first = word_spans(raw, off)
    out = np.empty(len(s), np.uint64)
    i = 0
    while i < len(s):  # words of about RUN_BYTES at once, so a long text takes no more than its words
        j = max(i + 1, int(np.searchsorted(e, s[i] + 2 * RUN_BYTES, "right")))
        a, b = s[i], e[j - 1]
        p, q = _pow(int(b - a))
        terms = (_LOWER[raw[a:b]] if lower else raw[a:b]).astype(np.uint64)
        terms += np.uint64(1)
        terms *= p[: b - a]
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(terms, out=sums[1:])
        h = (sums[e[i:j] - a] - sums[s[i:j] - a]) * q[s[i:j] - a]
        h += (e[i:j] - s[i:j]).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        out[i:j] = mix64(h)
        i = j
    return out, first


def hash_shingles(h: np.ndarray, first: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles.

    A text of fewer than k words has one shingle, its whole sequence; without words none.
    """
    n = len(h)
    mult = mix64(np.arange(1, 2 * k + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
    out: list[np.ndarray] = []
    if n >= k:
        s = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            s += h[j : n - k + 1 + j] * mult[j]
        s = mix64(s)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        m = b - a
        if m >= k:
            out.append(np.unique(s[a : b - k + 1]))
        elif m:
            x = np.append(h[a:b] * mult[:m], mult[k + m - 1]).sum(dtype=np.uint64)
            out.append(mix64(np.array([x], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
