"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds its anchors: at-signs, digits, plus signs, schemes and
words that announce an account or a secret. Around each anchor a deterministic parser expands to
the boundaries of what the anchor can belong to, and validates it. Text without anchors costs
nothing more than the pass.

Base kinds are email, ip, card and phone (leftmost, not overlapping within a kind; a candidate that
fails validation is dropped and not retried). Added kinds: url, iban and secret (the value after a
cue such as ``token =``).
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import map_arrow
from .common import text_or_empty

KINDS = ("email", "ip", "card", "phone", "url", "iban", "secret")
#: What announces a place where data may stand.
SCHEMES = ("http://", "https://", "ftp://")
CUES = ("token", "api_key", "apikey", "api-key", "secret", "password", "passwd", "access_key")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_LABEL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-")
_DIGITS = frozenset("0123456789")
_SPREAD = frozenset(" ().0123456789-")
_VALUE = re.compile(r"[ \t]{0,8}[\"']?[ \t]{0,8}[=:][ \t]{0,8}([\"']?)([A-Za-z0-9_\-+/.=]{12,})\1")
_URL = re.compile(r"[^\s<>\"'`\\^{|}]+")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_automaton = None


def _anchors():
    global _automaton
    if _automaton is None:
        import ahocorasick

        a = ahocorasick.Automaton()
        for c in "0123456789":
            a.add_word(c, ("#", 1))
        a.add_word("@", ("@", 1))
        a.add_word("+", ("+", 1))
        for s in SCHEMES:
            a.add_word(s, ("url", len(s)))
        for s in CUES:
            for form in {s, s.upper(), s.capitalize()}:
                a.add_word(form, ("cue", len(s)))
        a.make_automaton()
        _automaton = a
    return _automaton


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _email(t: str, at: int, floor: int) -> tuple[int, int] | None:
    a = at
    while a > floor and t[a - 1] in _LOCAL:
        a -= 1
    if a == at:
        return None
    n, e = len(t), at + 1
    while e < n and t[e] in _LABEL:
        e += 1
    if e == at + 1:
        return None
    end = None
    while e + 1 < n and t[e] == "." and t[e + 1] in _LABEL:
        e += 2
        while e < n and t[e] in _LABEL:
            e += 1
        end = e
    return (a, end) if end else None


def _ip(t: str, a: int) -> tuple[int, int, bool] | None:
    """The dotted quad that begins with the digits at a: start, end, whether it is valid."""
    n, e, ok = len(t), a, True
    for part in range(4):
        if part:
            if e >= n or t[e] != ".":
                return None
            e += 1
        b = e
        while e < n and t[e] in _DIGITS:
            e += 1
        if e == b:
            return None
        ok = ok and int(t[b:e].lstrip("0")[:4] or "0") <= 255
    return a, e, ok


def _digit_run(t: str, a: int) -> int:
    e, n = a + 1, len(t)
    while e < n and t[e] in _DIGITS:
        e += 1
    return e


def _card(t: str, a: int) -> int:
    """End of the digits at a with single spaces or hyphens between them."""
    e, n = a + 1, len(t)
    while e < n:
        if t[e] in _DIGITS:
            e += 1
        elif t[e] in " -" and e + 1 < n and t[e + 1] in _DIGITS:
            e += 2
        else:
            break
    return e


def _phone(t: str, a: int) -> int | None:
    """End of the number that begins with the plus sign at a."""
    n = len(t)
    if a + 1 >= n or t[a + 1] not in _DIGITS:
        return None
    e, last = a + 2, None
    while e < n and t[e] in _SPREAD:
        if e > a + 2 and t[e] in _DIGITS:
            last = e + 1
        e += 1
    return last


def find(t: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start, then kind as listed."""
    out: list[tuple[int, int, str]] = []
    free = dict.fromkeys(KINDS, 0)
    ip_at = 0
    for last, (what, size) in _anchors().iter(t):
        at = last - size + 1
        if what == "#":
            if at >= free["card"]:
                e = _card(t, at)
                if e > at + 1:
                    free["card"] = e
                    if e - at >= 12:
                        digits = "".join(c for c in t[at:e] if c in _DIGITS)
                        if 12 <= len(digits) <= 19 and _luhn(digits):
                            out.append((at, e, "card"))
            if at >= ip_at:
                quad = _ip(t, at)
                if quad:
                    ip_at = quad[1]
                    if quad[2]:
                        out.append((at, quad[1], "ip"))
                else:
                    ip_at = _digit_run(t, at)
            if at >= free["iban"] and at >= 2 and at + 2 < len(t) and "A" <= t[at - 1] <= "Z" and "A" <= t[at - 2] <= "Z" and (at == 2 or not t[at - 3].isalnum()):
                m = _IBAN.match(t, at - 2)
                if m:
                    s = m[0].replace(" ", "")
                    if 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1:
                        out.append((m.start(), m.end(), "iban"))
                        free["iban"] = m.end()
        elif what == "@":
            m = _email(t, at, free["email"])
            if m:
                free["email"] = m[1]
                out.append((*m, "email"))
        elif what == "+":
            if at >= free["phone"]:
                e = _phone(t, at)
                if e:
                    free["phone"] = e
                    if 9 <= sum(c in _DIGITS for c in t[at:e]) <= 15:
                        out.append((at, e, "phone"))
        elif what == "url":
            if at >= free["url"]:
                m = _URL.match(t, at + size)
                if m:
                    e = at + size + len(m[0].rstrip(".,;:!?)]"))
                    if e > at + size:
                        out.append((at, e, "url"))
                    free["url"] = m.end()
        elif at >= free["secret"]:
            m = _VALUE.match(t, last + 1)
            if m:  # a value without digits has no part with one either, so what it covers is not gone through again
                free["secret"] = m.end(2)
                if any(c in _DIGITS for c in m[2]):
                    out.append((m.start(2), m.end(2), "secret"))
    rank = {k: i for i, k in enumerate(KINDS)}
    return sorted(out, key=lambda s: (s[0], rank[s[2]], s[1]))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id and its spans, an array of (start, end, kind, value).

    Nulls: a null text is empty, a null id stays null. Repeated rows return as often as they come,
    empty tables give empty tables. Spans that start together are ordered by kind as listed.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def scan(batches):
        t = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("value", pa.string())]))
        for b in batches:
            spans = []
            for x in b.column(1):
                text = x.as_py()
                spans.append([{"start": a, "end": e, "kind": k, "value": text[a:e]} for a, e, k in find(text)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, t)], ["id", "spans"])

    base = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    return map_arrow(base, scan, f"id {kind}, spans array<struct<start: long, end: long, kind: string, value: string>>")


def query(docs: DataFrame) -> DataFrame:
    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")

    def count(k):
        return F.size(F.filter("spans", lambda s: s.kind == k)).cast("long").alias(f"n_{k}")

    base = F.filter("spans", lambda s: s.kind.isin("email", "ip", "card", "phone"))
    return personal_data(docs).select(
        F.col("id").alias("doc_id"), *[count(k) for k in KINDS[:4]],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def digest(spans: list[tuple[int, int, str]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{e}" for a, e, k in spans).encode()).hexdigest()
