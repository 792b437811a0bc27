"""Best-fit packing of token sequences with large-item matching.

Tokens are counted where the text lies. What leaves a task is a row per piece; how many pieces of
each length there are decides the packing, so the plan is made from at most ``capacity`` numbers:

* pieces above a third of the capacity go at most two to a sequence; going down the lengths, each
  is matched with the longest other one that still fits;
* smaller pieces, longest first, go to the smallest gap that holds them.

Pieces of one length are alike, so steps are taken for all of them at once, as (pattern, times).
Pieces get their places by their rank within their length, from counts per task and length.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import map_arrow
from .common import cut, text_or_empty

VOCABULARY, RANKS, END = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", 0
#: Texts with these go through the slower of the two tokenizers with the same vocabulary: the
#: special token, and characters whose class (space or not) the two pattern libraries may see differently.
_SPANS = ((0x1C, 0x1F), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x180E, 0x180E), (0x2000, 0x200F), (0x2028, 0x202F), (0x205F, 0x2060), (0x3000, 0x3000), (0xFEFF, 0xFEFF))
_ODD = re.compile(r"<\|endoftext\|>|[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in _SPANS) + "]")
_state: dict = {}


def _tokenizers(folder: str | None):
    if folder not in _state:
        import base64
        import os

        import tiktoken
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        if folder is None:
            import public_tokenizers as own

            place, pattern = own.path, own.PATTERN
        else:
            place = lambda name: os.path.join(folder, name)
            pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        with open(place(RANKS), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        _state[folder] = fast, Tokenizer.from_file(place(VOCABULARY))
    return _state[folder]


def token_ids(text: str, folder: str | None = None) -> np.ndarray:
    """The ids of a text, without the closing one."""
    fast, exact = _tokenizers(folder)
    if _ODD.search(text):
        return np.array(exact.encode(text, add_special_tokens=False).ids, np.uint32)
    return fast.encode_to_numpy(text, disallowed_special=()).astype(np.uint32, copy=False)


def pieces(ids: np.ndarray, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length): whole if it fits, else full pieces behind a possibly shorter first one."""
    n = len(ids)
    at, size = 0, (n - 1) % capacity + 1
    while at < n:
        yield at, size
        at, size = at + size, capacity


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """counts of lengths -> (length, first rank, first sequence, times, offset) of every slot.

    The piece of that length with rank ``first rank + k`` lies in sequence ``first sequence + k``
    at that offset, for k < times.
    """
    left = {k: v for k, v in counts.items() if v > 0}
    taken = dict.fromkeys(left, 0)
    slots: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> [(first sequence, times)]
    order: list[int] = []
    made = 0

    def put(length: int, seq: int, times: int, offset: int) -> None:
        slots.append((length, taken[length], seq, times, offset))
        taken[length] += times
        left[length] -= times

    def leave(gap: int, seq: int, times: int) -> None:
        if gap and times:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((seq, times))

    third = capacity // 3
    large = sorted(k for k in left if k > third)
    while large:
        a = large[-1]
        if not left[a]:
            large.pop()
            continue
        i = bisect_left(large, capacity - a + 1) - 1  # the longest that fits beside it
        while i >= 0 and not (left[large[i]] > (large[i] == a)):
            i -= 1
        if i < 0:
            n = left[a]
            put(a, made, n, 0)
            leave(capacity - a, made, n)
        else:
            b = large[i]
            n = left[a] // 2 if a == b else min(left[a], left[b])
            put(a, made, n, 0)
            put(b, made, n, a)
            leave(capacity - a - b, made, n)
        made += n
    for s in sorted((k for k in left if k <= third), reverse=True):
        while left[s]:
            i = bisect_left(order, s)
            if i == len(order):
                per = capacity // s
                n = max(1, left[s] // per)
                seq, gap = made, capacity
                made += n
            else:
                gap = order[i]
                seq, have = gaps[gap].pop()
                per = gap // s
                n = max(1, min(have, left[s] // per))
                if have > n:
                    gaps[gap].append((seq + n, have - n))
                elif not gaps[gap]:
                    del gaps[gap], order[i]
            k = 0
            while k < per and left[s] >= n:
                put(s, seq, n, capacity - gap + k * s)
                k += 1
            leave(gap - k * s, seq, n)
    return slots


def token_pieces(docs: DataFrame, capacity: int, id_col: str, text_col: str, folder: str | None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and the piece's rank among its length in its task."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"

    def cut_up(batches):
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(token_ids(text.as_py(), folder), np.uint32(END)).astype("<u4")
                for k, (at, size) in enumerate(pieces(ids, capacity)):
                    rows.append((doc, k, at, size, zlib.crc32(ids[at : at + size].tobytes()), part, seen[size]))
                    seen[size] += 1
            cols = list(zip(*rows)) or [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))],
                ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return map_arrow(texts, cut_up, schema)


def pack(docs: DataFrame, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", tokenizer_dir: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Nulls: a null text is the closing token alone; a null id stays null. Repeated rows are packed as
    often as they come. Pieces of equal length are interchangeable; ties go to the lower task and the
    earlier row. An empty table gives an empty table. ``tokenizer_dir`` holds the vocabulary files;
    by default the installed ones.

    The driver sees one count per length, never a document; the plan has a few slots per length.
    """
    items = cut(token_pieces(docs, capacity, id_col, text_col, tokenizer_dir))
    per_task = items.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per_task = cut(per_task.withColumn("skip", F.coalesce(F.sum("n").over(before), F.lit(0))))
    counts = {r[0]: r[1] for r in per_task.groupBy("length").agg(F.sum("n")).collect()}  # at most `capacity` rows
    slots = sorted(plan(counts, capacity))
    lengths = np.array([s[0] for s in slots], np.int64)
    ranks = np.array([s[1] for s in slots], np.int64)
    seqs, offs = np.array([s[2] for s in slots], np.int64), np.array([s[4] for s in slots], np.int64)
    starts = {int(k): (int(a), int(b)) for k, a, b in zip(*_spans(lengths))}

    def place(batches):
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            at = np.zeros(len(length), np.int64)
            for k in np.unique(length).tolist():
                lo, hi = starts[k]
                of = length == k
                at[of] = lo + np.searchsorted(ranks[lo:hi], rank[of], "right") - 1
            cols = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            seq = seqs[at] + rank - ranks[at] if len(at) else at
            yield pa.RecordBatch.from_arrays([*cols, pa.array(seq, pa.int64()), pa.array(offs[at] if len(at) else at, pa.int64())],
                                             ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    # a row per task and length: small beside the pieces, and joined on its whole key
    ranked = items.join(per_task.select("length", "part", "skip"), ["length", "part"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("skip") + F.col("nth")).alias("rank"))
    return map_arrow(ranked, place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def _spans(sorted_keys: np.ndarray):
    k, a = np.unique(sorted_keys, return_index=True)
    return k, a, np.append(a[1:], len(sorted_keys))
