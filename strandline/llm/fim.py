"""Fill-in-middle transformation on big integers.

A text is cut at two random units into prefix, middle and suffix, which come out in another order
behind sentinels. Units are found for a whole text at once, with one bit a byte of its UTF-8 form in
a big integer: ``bytes.translate`` builds the masks of byte classes, shifted boolean operations mark
where units begin, ``bit_count`` gives their number, and the place of a ranked bit is found by
halving the integer and counting the lower half. All of it is linear in the text.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import map_arrow
from .common import text_or_empty

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts so many at most are transformed, and of 100 transformed ones so many begin with the suffix.
TRANSFORMED, SUFFIX_FIRST = 90, 20
#: Bytes of results that a task gathers before it hands them on.
FLUSH = 1 << 24


def _class(holds) -> bytes:
    return bytes(49 if holds(b) else 48 for b in range(256))


_LEAD = _class(lambda b: b & 0xC0 != 0x80)
_INK = _class(lambda b: b not in b" \t\n\v\f\r")
_BREAK = _class(lambda b: b == 10)


def mask(raw: bytes, of: bytes) -> int:
    """Bit i tells whether byte i is of a class."""
    return int(raw.translate(of)[::-1], 2) if raw else 0


def begins(raw: bytes, unit: str = "char") -> int:
    """Bit i tells whether a unit begins at byte i.

    ``char``: a code point. ``word``: a word with the ASCII white space behind it; white space before
    the first word is a unit of its own. ``line``: a line with its line feed.
    """
    if unit == "char":
        return mask(raw, _LEAD)
    if unit == "word":
        ink = mask(raw, _INK)
        return (ink & ~(ink << 1)) | bool(raw)
    if unit == "line":
        return ((mask(raw, _BREAK) << 1) | bool(raw)) & ((1 << len(raw)) - 1)
    raise ValueError(f"unknown unit {unit!r}")


def place(bits: int, size: int, rank: int) -> int:
    """Which of the ``size`` bits is the set one with that rank (from 0); ``size`` beyond the last one."""
    if rank >= bits.bit_count():
        return size
    at = 0
    while size > 64:
        half = size >> 1
        low = bits & ((1 << half) - 1)
        below = low.bit_count()
        if rank < below:
            bits, size = low, half
        else:
            bits, size, rank, at = bits >> half, size - half, rank - below, at + half
    for _ in range(rank):
        bits &= bits - 1
    return at + (bits & -bits).bit_length() - 1


def rearrange(raw: bytes, h: list[int], unit: str, transformed: int, suffix_first: int, marks: tuple[bytes, bytes, bytes]):
    """(n, form, code points of the prefix and of the middle, output) of a text and its four numbers."""
    units = begins(raw, unit)
    n = units.bit_count()
    if not raw or any(m in raw for m in marks) or h[2] % 100 >= transformed:
        return n, "plain", None, None, raw
    a, b = sorted(place(units, len(raw), x % (n + 1)) for x in h[:2])
    chars = units if unit == "char" else begins(raw)
    upto = [(chars & ((1 << x) - 1)).bit_count() for x in (a, b)]
    head, mid, tail = raw[:a], raw[a:b], raw[b:]
    p, s, m = marks
    spm = h[3] % 100 < suffix_first
    out = b"".join((s, tail, p, head, m, mid) if spm else (p, head, s, tail, m, mid))
    return n, "spm" if spm else "psm", upto[0], upto[1] - upto[0], out


def draws(id_col: str, seed: int) -> list[Column]:
    """Four numbers of 32 bits for a row: the first digits of the hash of seed and id (a null id: no digits)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def transform(docs: DataFrame, unit: str = "char", seed: int = 1, transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST,
              id_col: str = "doc_id", text_col: str = "text", sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> DataFrame:
    """One row per row: doc_id, n, form, prefix_chars, middle_chars, output.

    ``n`` counts the units. The form is ``plain`` (the text as it is) for an empty text, one that holds
    a sentinel, and those not drawn; else ``psm`` or ``spm``, by the order of the parts in the output.
    Cuts depend on seed and id alone, so reruns and other partitions agree.

    Nulls: a null text is empty, a null id draws like an id without digits and stays null. Repeated
    rows come out as often as they come, alike. A text of any length is handled whole, in memory of a
    few times its size. No other column is read, whatever it is called. An empty table gives an empty one.
    """
    marks = tuple(x.encode() for x in sentinels)

    def kernel(batches):
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
        names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]

        def made(rows):
            cols = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
            cols[-1] = cols[-1].view(pa.string())
            return pa.RecordBatch.from_arrays(cols, names)

        rows, held = [], 0
        for batch in batches:
            hs = [batch.column(k).to_pylist() for k in range(2, 6)]
            for doc, text, *h in zip(batch.column(0).to_pylist(), batch.column(1), *hs):
                rows.append((doc, *rearrange(text.as_buffer().to_pybytes(), h, unit, transformed, suffix_first, marks)))
                held += len(rows[-1][-1])
                if held >= FLUSH:
                    yield made(rows)
                    rows, held = [], 0
        if rows:
            yield made(rows)

    begins(b"", unit)  # refuses unknown units before anything runs
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"), *draws(id_col, seed))
    return map_arrow(texts, kernel, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: str = "output", form: str = "form", sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that an output was made from: parts end at the first sentinel, as texts that hold one are plain."""
    p, s, m = sentinels

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        body = F.substr(F.col(output), F.lit(1 + len(first)))
        one = F.substring_index(body, second, 1)
        rest = F.substr(body, F.length(one) + 1 + len(second))
        two = F.substring_index(rest, m, 1)
        return one, two, F.substr(rest, F.length(two) + 1 + len(m))

    head, tail, mid = parts(p, s)
    tail2, head2, mid2 = parts(s, p)
    return F.when(F.col(form) == "psm", F.concat(head, mid, tail)).when(F.col(form) == "spm", F.concat(head2, mid2, tail2)).otherwise(F.col(output))


def query(docs: DataFrame) -> DataFrame:
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    made = transform(docs).withColumn("restored", restored())
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(F.col("restored")).alias("restored_sha256"))


ORACLE = """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
    h AS (SELECT doc_id, t, n, CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2, CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM d),
    f AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                 CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
    p AS (SELECT *, substring(t, 1, a) AS head, substring(t, a + 1, b - a) AS mid, substring(t, b + 1) AS tail FROM f)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || head || '<S>' || tail || '<M>' || mid
                            ELSE '<S>' || tail || '<P>' || head || '<M>' || mid END) AS output_sha256,
           sha256(t) AS restored_sha256
    FROM p"""
