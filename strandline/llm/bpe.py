"""Byte-pair encoding and decoding as streaming transducers.

Encoding reads a text in blocks. Text is normalised and split into words block by block; a word of
any length goes through `Merger`, which holds a bounded number of symbols: the merge list itself
tells how far ahead a boundary between tokens can depend on what follows, so tokens are emitted as
soon as they lie that far behind the end of what was read.

The bound. Rules are applied in the order of their ranks. Whether rule k = (s, c) joins s and c at
a place depends on what stands to the right only if c is there in one continuation and not in
another, that is if in one of them a rule j < k joins the right end of c (c itself, or a token of its
right edge before its own rule has taken it) with a token behind it, and in the other does not. So
what may reach k from the right lies within ``reach(k) = |c| + max reach(j)`` symbols over those
j, and as ranks fall along such a chain all of them are computed in one pass over the list. A boundary with
more than the greatest reach of known symbols behind it stays whatever comes, and as no rule ever
joins across a boundary that stays, encoding goes on behind it as if a word began there.

Decoding is a machine over ids that keeps the bytes of an unfinished character.
"""

from __future__ import annotations

import codecs
import heapq
import json
import os
import re
import struct
import unicodedata
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from hashlib import sha256
from itertools import repeat
from operator import add

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import map_arrow
from .common import text_or_empty

VOCABULARY = "word_bpe_49k.json"
#: Code points a block has, symbols a long word is merged by, characters of a word that is remembered, words remembered.
BLOCK, STEP, SHORT, WORDS = 1 << 16, 1 << 12, 48, 1 << 19
#: Bytes of ids or characters of text that a task gathers before it hands them on.
FLUSH = 1 << 22


class Rules:
    """A merge list with word ends, and how far ahead it has to look.

    Symbols are characters here, so that a word is a string of them and a pair two characters: the bytes within a word are
    0..255, the last byte of a word 256 more, what rule k makes 512 + k.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.special = spec["model"], {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab, self.end = model["vocab"], model["end_of_word_suffix"]
        self.token: dict[int, str] = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        letters = byte_letters()
        symbol = {t: chr(k) for k, t in enumerate([*letters, *(c + self.end for c in letters)])}
        self.rank: dict[str, int] = {}
        self.made: list[str] = []
        for k, pair in enumerate(model["merges"]):
            x, y = pair.split(" ") if isinstance(pair, str) else pair
            if x + y in symbol:
                raise ValueError("a token is made by two rules")
            self.rank[symbol[x] + symbol[y]] = k  # a part that no rule has made yet is no key: then the list is refused
            symbol[x + y] = chr(512 + k)
            self.made.append(chr(512 + k))
        self.packed = {c: struct.pack("<I", vocab[t]) for t, c in symbol.items()}
        self.joins, self.none = list(zip(self.rank, self.made)), repeat(len(self.made))
        self.length = dict.fromkeys(map(chr, range(512)), 1)
        self.lookahead = self._reach()
        self.longest = max(self.length.values())

    def _reach(self) -> int:
        """The greatest reach of a rule, in symbols."""
        ranks: dict[str, list[int]] = {}  # by left symbol: ranks of its rules, rising
        upto: dict[str, list[int]] = {}  # and the greatest reach of these and those before
        tree: dict[str, tuple[int, str]] = {}  # symbol -> (its rule, its right part)
        most = 0
        for (s, c), k in self.rank.items():
            self.length[self.made[k]] = self.length[s] + self.length[c]
            reach, edge, bound = 0, c, k
            while True:
                n = bisect_left(ranks.get(edge, ()), bound)
                if n:
                    reach = max(reach, upto[edge][n - 1])
                if edge not in tree:
                    break
                bound, edge = tree[edge]
            reach += self.length[c]
            most = max(most, reach)
            ranks.setdefault(s, []).append(k)
            best = upto.setdefault(s, [])
            best.append(max(reach, best[-1]) if best else reach)
            tree[self.made[k]] = k, c
        return most

    def pack(self, symbols: str) -> bytes:
        return b"".join(map(self.packed.__getitem__, symbols))

    def merge(self, symbols: str) -> str:
        """Apply the rules: lowest rank first, leftmost first."""
        rank, made, n = self.rank, self.made, len(symbols)
        if n <= SHORT:
            return self._merge_few(symbols)
        at, nxt, prv = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank[p], i, p) for i, p in enumerate(map(add, symbols, symbols[1:])) if p in rank]
        heapq.heapify(heap)
        while heap:
            k, i, pair = heapq.heappop(heap)
            j = nxt[i]
            if j >= n or at[i] + at[j] != pair:
                continue
            at[i], at[j] = made[k], ""
            nxt[i] = m = nxt[j]
            if m < n:
                prv[m] = i
                p = at[i] + at[m]
                if p in rank:
                    heapq.heappush(heap, (rank[p], i, p))
            h = prv[i]
            if h >= 0:
                p = at[h] + at[i]
                if p in rank:
                    heapq.heappush(heap, (rank[p], h, p))
        return "".join(at)

    def _merge_few(self, symbols: str) -> str:
        """All places of the lowest pair at once: what a rule makes is a part of later rules only."""
        rank, joins, none, last = self.rank.get, self.joins, self.none, len(self.made)
        k = min(map(rank, map(add, symbols, symbols[1:]), none), default=last)
        while k < last:
            pair, new = joins[k]
            symbols = symbols.replace(pair, new)
            k = min(map(rank, map(add, symbols, symbols[1:]), none), default=last)
        return symbols


class Words(dict):
    """Ids of words that came lately, packed; a bounded number of bounded words."""

    def __init__(self, rules: Rules) -> None:
        self.rules, self.merger = rules, Merger(rules)

    def __missing__(self, word: str) -> bytes:
        raw = word if word.isascii() else word.encode().decode("latin-1")
        if len(raw) > SHORT:
            return b"".join(self.merger.feed(raw)) + self.merger.close()
        rules = self.rules
        ids = b"".join(map(rules.packed.__getitem__, rules._merge_few(raw[:-1] + chr(256 + ord(raw[-1])))))
        if len(self) >= WORDS:
            self.clear()
        self[word] = ids
        return ids


class Merger:
    """One word at a time, its bytes as characters, in pieces of any size; holds at most ``step`` and the bound's symbols."""

    def __init__(self, rules: Rules, step: int = STEP) -> None:
        self.rules, self.step, self.full = rules, step, step + rules.lookahead + rules.longest
        self.held = ""
        self.last = ""  # the last byte read: it may be the word's last

    def feed(self, piece: str) -> Iterator[bytes]:
        for a in range(0, len(piece), self.step):
            part = self.last + piece[a : a + self.step]
            self.held, self.last = self.held + part[:-1], part[-1]
            if len(self.held) > self.full - self.step:
                yield self._stable()

    def close(self) -> bytes:
        """The rest of the word."""
        if not self.last:
            return b""
        out = self.rules.merge(self.held + chr(256 + ord(self.last)))
        self.held = self.last = ""
        return self.rules.pack(out)

    def _stable(self) -> bytes:
        tokens, length = self.rules.merge(self.held), self.rules.length
        k, behind = len(tokens), 0
        while behind <= self.rules.lookahead:
            k -= 1
            behind += length[tokens[k]]
        # the boundary before token k has more than the bound behind it
        self.held = self.held[len(self.held) - behind :]
        return self.rules.pack(tokens[:k])


class Encoder:
    """A text in blocks of code points; what is kept between them is the rest of a block and an open word."""

    WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
    PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII)
    OPEN = {"L": regex.compile(r"\p{L}*"), "O": regex.compile(r"[^\s\p{L}\p{N}]*")}

    def __init__(self, path: str, step: int = STEP) -> None:
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self.rules = Rules(path)
        self.normal, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.merger, self.open = Merger(self.rules, step), ""
        self.words = Words(self.rules)
        self.found = regex.compile("|".join(map(regex.escape, self.rules.special)))
        self.classes: dict[str, str] = {}

    def encode(self, text: str, block: int = BLOCK) -> Iterator[bytes]:
        """Ids as little-endian 32-bit numbers, in pieces."""
        at = 0
        while at < len(text):
            end = self._cut(text, at, block)
            yield from self._block(text[at:end])
            at = end
        yield from self._close()

    def _cut(self, text: str, at: int, block: int) -> int:
        """Where a block may end: no special token, contraction or composed character goes on there."""
        end = at + block
        if end >= len(text):
            return len(text)
        low, stop = max(at + 1, end - 256), end
        while end > low and not self._cuts(text, end):
            end -= 1
        if end == low:
            end = stop + 1
            while end < len(text) and not self._cuts(text, end):
                end += 1
        return end

    def _cuts(self, text: str, i: int) -> bool:
        if not starts_anew(text[i]) or "'" in text[i - 2 : i]:
            return False
        for token in self.rules.special:
            p = text.find(token[0], max(0, i - len(token) + 1), i)
            while p >= 0:
                if text.startswith(token, p):
                    return False
                p = text.find(token[0], p + 1, i)
        return True

    def _block(self, raw: str) -> Iterator[bytes]:
        at = 0
        for m in self.found.finditer(raw):
            yield from self._plain(raw[at : m.start()])
            yield from self._close()
            yield struct.pack("<I", self.rules.special[m[0]])
            at = m.end()
        yield from self._plain(raw[at:])

    def _plain(self, raw: str) -> Iterator[bytes]:
        if not raw:
            return
        if raw.isascii():
            text = shadow = raw.lower()
        else:
            young = [c for c in set(raw) if unicodedata.category(c) == "Cn"]
            # the library's own tables where this interpreter's do not know a character; white space stays, it is dropped anyway
            text = self.normal(raw) if young else unicodedata.normalize("NFC", raw).replace("Σ", "σ").lower()
            shadow = self._shadow(text) if young else text
        at = 0
        if self.open:
            at = self.OPEN[self.open].match(shadow).end()
            if at:
                yield from self.merger.feed(text[:at].encode().decode("latin-1"))
            if at == len(text):
                return
            yield from self._close()
        spans = None
        if shadow is text:
            words = (self.PLAIN if at == 0 and raw.isascii() else self.WORD).findall(text, at)
        else:
            spans = [m.span() for m in self.WORD.finditer(shadow, at)]
            words = [text[a:b] for a, b in spans]
        if words and self._goes_on(shadow, spans[-1] if spans else (len(text) - len(words[-1]), len(text)) if text.endswith(words[-1]) else (0, 0)):
            last = words.pop()
        else:
            last = ""
        yield b"".join(map(self.words.__getitem__, words))
        if last:
            self.open = "L" if self.OPEN["L"].match(shadow[-1]).end() else "O"
            yield from self.merger.feed(last.encode().decode("latin-1"))

    def _goes_on(self, shadow: str, span: tuple[int, int]) -> bool:
        """Whether the last word of a block may continue in the next one."""
        a, b = span
        if b < len(shadow) or a == b or shadow[b - 1].isspace():
            return False
        first, end = shadow[a], shadow[b - 1]
        one_class = lambda k: self.OPEN[k].match(first).end() and self.OPEN[k].match(end).end()
        return bool(one_class("L") or one_class("O"))

    def _close(self) -> Iterator[bytes]:
        self.open = ""
        yield self.merger.close()

    def _shadow(self, text: str) -> str:
        """The text with characters younger than this interpreter's tables replaced by one of the class that the library gives them."""
        young = [c for c in set(text) if unicodedata.category(c) == "Cn"]
        if not young:
            return text
        for c in young:
            if c not in self.classes:
                alone = lambda s: len(self.split(s)) == 1
                self.classes[c] = "a" if alone("a" + c) else "!" if alone("!" + c) else "1"
        return text.translate({ord(c): self.classes[c] for c in young})


class Decoder:
    """Ids to text in pieces of any size.

    By default text is what the library gives for this vocabulary: its tokens with spaces between.
    ``readable``: the bytes that the tokens stand for, word ends as spaces. Ids that are null or not in the
    vocabulary are passed over, bytes that form no character become U+FFFD.
    """

    def __init__(self, path: str, readable: bool = False) -> None:
        rules = Rules(path)
        self.between = b"" if readable else b" "
        byte = {c: b for b, c in enumerate(byte_letters())}
        self.table = {i: t.encode() for i, t in rules.token.items()}
        if readable:
            for i, t in rules.token.items():
                if t not in rules.special:
                    end = t.endswith(rules.end)
                    self.table[i] = bytes(byte[c] for c in (t[: -len(rules.end)] if end else t)) + b" " * end
        self.reset()

    def reset(self) -> None:
        self.first, self.text = True, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        try:
            raw = self.between.join(map(self.table.__getitem__, ids))
        except KeyError:
            raw = self.between.join([t for t in map(self.table.get, ids) if t is not None])
        if raw and not self.first:
            raw = self.between + raw
        self.first &= not raw
        return self.text.decode(raw)

    def close(self) -> str:
        out = self.text.decode(b"", True)
        self.reset()
        return out


def byte_letters() -> list[str]:
    """The character that stands for each byte: itself if it prints, else the next free one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, free = [], 256
    for b in range(256):
        if b in prints:
            out.append(chr(b))
        else:
            out.append(chr(free))
            free += 1
    return out


def starts_anew(c: str) -> bool:
    """Whether composing characters before this one and from it on is the same as composing all of them."""
    if c.isascii():
        return True
    head = unicodedata.normalize("NFD", c)[0]
    jamo = "ᄀ" <= head <= "ᇿ" or "ꥠ" <= head <= "꥿" or "ힰ" <= head <= "퟿"
    return not jamo and unicodedata.category(head)[0] != "M" and unicodedata.category(head) != "Cn"


_made: dict = {}


def vocabulary_path(folder: str | None) -> str:
    if folder is not None:
        return os.path.join(folder, VOCABULARY)
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _kept(kind, folder: str | None, *more):
    """One machine of a kind for each worker."""
    key = kind, folder, *more
    if key not in _made:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _made[key] = kind(vocabulary_path(folder), *more)
    return _made[key]


def encoding(folder: str | None = None):
    """Batches of (id, text) -> batches of (doc_id, ids)."""
    def made(rows):
        values = pa.array(np.frombuffer(b"".join(r[1] for r in rows), "<i4"), pa.int32())
        sizes = np.cumsum([0, *(len(r[1]) // 4 for r in rows)])
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), values)], ["doc_id", "ids"])

    def kernel(batches):
        machine = _kept(Encoder, folder)
        rows, held = [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows.append((doc, b"".join(machine.encode(text.as_py()))))
                held += len(rows[-1][1])
                if held >= FLUSH:
                    yield made(rows)
                    rows, held = [], 0
        if rows:
            yield made(rows)

    return kernel


def decoding(folder: str | None = None, readable: bool = False):
    """Batches of (id, ids) -> the same with the text."""
    def kernel(batches):
        machine = _kept(Decoder, folder, readable)

        def made(rows, ids):
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), ids, pa.array([r[1] for r in rows], pa.string())], ["doc_id", "ids", "decoded"])

        for batch in batches:
            rows, held, since, column = [], 0, 0, batch.column(1)
            for k, doc in enumerate(batch.column(0).to_pylist()):
                ids = column[k].values
                text = "".join([machine.feed(ids[a : a + BLOCK].to_pylist()) for a in range(0, len(ids), BLOCK)]) + machine.close()
                rows.append((doc, text))
                held += len(text)
                if held >= FLUSH:
                    yield made(rows, column[since : k + 1])
                    rows, held, since = [], 0, k + 1
            if rows:
                yield made(rows, column[since:])

    return kernel


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_dir: str | None = None) -> DataFrame:
    """One row per row: doc_id, ids (array of int).

    Nulls: a null text is empty and has no ids, a null id stays null. Repeated rows come out as often as they
    come. No other column is read. An empty table gives an empty one. Texts of any length are encoded whole;
    beside the ids themselves the encoder holds a block of code points and, of a long word, `STEP` symbols and
    the lookahead of the merge list. Only composing characters without a plain one between them make a block longer.
    """
    return map_arrow(_texts(docs, id_col, text_col), encoding(tokenizer_dir), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, readable: bool = False, id_col: str = "doc_id", ids_col: str = "ids", tokenizer_dir: str | None = None) -> DataFrame:
    """One row per row: doc_id, ids as they came, decoded (text).

    Null ids and ids that the vocabulary does not have are passed over; a null array is an empty one and its
    text empty. Repeated rows, extra columns and an empty table as for `encode`.
    """
    rows = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))
    return map_arrow(rows, decoding(tokenizer_dir, readable), "doc_id long, ids array<int>, decoded string")


def query(docs: DataFrame) -> DataFrame:
    """Digests of what both directions give, taken in the pass that makes it."""
    encoded, decoded = encoding(), decoding()

    def digests(batches):
        hashed = lambda raw: sha256(raw).hexdigest()
        for b in decoded(encoded(batches)):
            ids = b.column("ids")
            values, offsets = ids.values.to_numpy(), ids.offsets.to_numpy()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), pa.array([hashed(values[a:z].astype("<u4").tobytes()) for a, z in zip(offsets, offsets[1:])], pa.string()),
                                              pa.array([hashed(x.as_buffer()) for x in b.column("decoded")], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(_texts(docs, "doc_id", "text"), digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
