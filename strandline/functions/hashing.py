"""Hash functions on columns, safe under ANSI arithmetic (no product or shift may overflow)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASK32 = (1 << 32) - 1


def xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def times32(x: Column, factor: int) -> Column:
    """x * factor modulo 2**32 for 32-bit x, through the factor's halves."""
    high, low = factor >> 16, factor & 0xFFFF
    return (x * low + (x * high).bitwiseAND(F.lit(0xFFFF)) * 65536).bitwiseAND(F.lit(MASK32))


def fast_hash(x: Column) -> Column:
    """The 32-bit mixer of s-mers and k-mers."""
    x = xor(x, F.shiftright(x, 13))
    x = times32(x, 0x85EBCA6B)
    return xor(x, F.shiftright(x, 16))


def masked_steps(k: int) -> list:
    """The steps of the invertible hash of 2k-bit keys (k <= 28), each a function of a column; left shifts are masked beforehand."""
    mask = (1 << 2 * k) - 1

    def left(x: Column, n: int) -> Column:
        keep = mask >> n
        return F.shiftleft(x.bitwiseAND(F.lit(keep).cast("long")), n)

    def add(x: Column, y: Column) -> Column:
        return (x + y).bitwiseAND(F.lit(mask).cast("long"))

    return [
        lambda x: add(F.lit(mask).cast("long") - x, left(x, 21)),
        lambda x: xor(x, F.shiftright(x, 24)),
        lambda x: add(add(x, left(x, 3)), left(x, 8)),
        lambda x: xor(x, F.shiftright(x, 14)),
        lambda x: add(add(x, left(x, 2)), left(x, 4)),
        lambda x: xor(x, F.shiftright(x, 28)),
        lambda x: add(x, left(x, 31)),
    ]


def masked_hash(key: Column, k: int) -> Column:
    """The invertible hash of 2k-bit keys as one expression; it holds the key some hundred times, see ``with_masked_hash``."""
    x = key.cast("long")
    for step in masked_steps(k):
        x = step(x)
    return x


def with_masked_hash(df: DataFrame, name: str, key: str, k: int) -> DataFrame:
    """A table with the hash of a column, a projection a step, so that each step is evaluated once a row."""
    df = df.withColumn(name, F.col(key).cast("long"))
    for step in masked_steps(k):
        df = df.withColumn(name, step(F.col(name)))
    return df


def mixed64(x: Column) -> tuple[Column, Column]:
    """One round of 64-bit mixing of a long: the upper and the lower 32 bits of the result."""
    factor = 0xFF51AFD7ED558CCD
    low32 = F.lit(MASK32)
    x = xor(x, F.shiftrightunsigned(x, 33))
    a, b = x.bitwiseAND(low32), F.shiftrightunsigned(x, 32)
    c, d = factor & MASK32, factor >> 32
    # a * c by halves of c; what passes 32 bits is carried
    p, q = a * (c & 0xFFFF), a * (c >> 16)
    lower = p + q.bitwiseAND(F.lit(0xFFFF)) * 65536
    upper = (F.shiftright(lower, 32) + F.shiftright(q, 16) + times32(a, d) + times32(b, c)).bitwiseAND(low32)
    return upper, xor(lower.bitwiseAND(low32), F.shiftright(upper, 1))
