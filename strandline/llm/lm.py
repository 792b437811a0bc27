"""Language-model scores by online logistic context mixing.

A text is its words (A-Z lower-cased), each spelled by its bytes and a space, and one end. All of it is
predicted bit by bit, in a code from which it can be read back. The words of a dictionary, the corpus'
most frequent ones, stand in the order of their spellings, and each bit says on which side of a split
the spelling lies; splits halve the words' counts, so a word has about as many bits as it takes. Any
other word is spelled out, byte by byte, behind an escape.

Predictors look up counts of what followed a hashed context: for dictionary bits no word, the last
word and the last two words, each with the bits so far; for spelled bytes none, the last and the last
two bytes (counted in the distinct words), each with the byte's bits so far. Their stretched chances are summed with weights chosen
by a gate (how often the contexts came). Weights are learned on all training texts
and refined by gradient steps within each text, a block being scored before it is learned from. A
training text is predicted from counts without the occurrence that is predicted, as it is scored
before it is learned from.

Counts of contexts grow with the input and are held nowhere as a whole. Each chunk of texts sends its
distinct pairs of a context (the last word, the last two) and word to the parts, ranges of contexts' hashes,
where they are added up; each part answers with the counts along the bits of just the chunk's pairs. What
follows a fixed number of very frequent words is added up by ``groupBy`` and broadcast instead.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import map_arrow, ship
from .common import _LOWER, cut, hash_words, mix64, release, runs, text_or_empty, word_spans

#: Dictionary words, with the end and the escape a power of two of leaves; bits of a spelling's branches that are kept.
RANK_BITS = 17
HEAD = (1 << RANK_BITS) - 2
PATH_BITS = 48
#: Counts of what follows so many very frequent words are broadcast; those of other last words come from the parts.
HOT = 16
#: Texts are sent in chunks of about so many bytes; contexts are counted in one part for each so many bytes of input.
#: Parts grow with the root of the input from 1 GB on, up to GROWN times, as chunks times parts are sent; chunks with a quarter of it.
CHUNK_BYTES, PART_BYTES, GROWN = 14 << 20, 3 << 20, 8
#: Texts of a chunk are scored in slices of about so many tokens, and answers taken in by so many pairs.
SLICE, MERGED = 1 << 18, 1 << 17
#: Rows for parts leave a chunk in batches of about so many bytes.
BATCH_BYTES = 2 << 20
#: Training texts from which hot words are chosen, and their bytes, at most; with ``every_word`` scores do not depend on the choice.
SAMPLE_TEXTS, SAMPLE_BYTES = 200, 1 << 19
#: Bits that weights are learned from are added up by gate and by each chance in so many steps of a half; sums are whole numbers of so small a part.
STEPS, UNIT = 16, 1 << 16
#: Texts that weights are learned from are taken in chunks of about so many bytes, within which their contexts are counted.
LEARNED_BYTES = 8 << 20
END, ESCAPE, SPACE = b"\n", b"\x0b", b" "
END_HASH = np.uint64(0x51ED270B7A1F6E03)
BOS = np.uint64(0x2545F4914F6CDD1D)
#: Tokens of the first block of a text and of each later one; size of a gradient step.
FIRST_BLOCK, BLOCK, RATE = 32, 128, 0.15
DELTA = 0.4
MIXED = 3
#: From how often a context came to its place in the gate, as a table and by the bounds of its levels.
_GATE = np.array([0, 1, 2, 3, 3, 3, 3, 3, 3, *[4] * 247], np.uint8)
_BOUNDS = 0, 1, 2, 8
LEVELS = 5
GATES = LEVELS * LEVELS


# ---------------------------------------------------------------- tokens

def tokens(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of a run with the end of each text, and where each text's tokens begin."""
    h, first = hash_words(raw, off)
    n = len(off) - 1
    begin = first + np.arange(n + 1)
    out = np.empty(len(h) + n, np.uint64)
    ends = begin[1:] - 1
    keep = np.ones(len(out), bool)
    keep[ends] = False
    out[ends] = END_HASH
    out[keep] = h
    return out, begin


def spelled(raw: np.ndarray, s: np.ndarray, e: np.ndarray) -> pa.Array:
    """The words at these places, A-Z lower-cased."""
    lens = e - s
    off = np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)
    at = np.repeat(s - off[:-1], lens) + np.arange(off[-1])
    return pa.Array.from_buffers(pa.binary(), len(s), [None, pa.py_buffer(off), pa.py_buffer(_LOWER[raw[at]])])


def last_two(t: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last word before each token and the one before that."""
    one, two = np.full(len(t), BOS), np.full(len(t), BOS)
    one[1:], two[2:] = t[:-1], t[:-2]
    at = begin[:-1]
    one[at] = BOS
    two[at] = BOS
    second = at + 1
    two[second[second < begin[1:]]] = BOS
    return one, two


def token_hashes(words: list[bytes]) -> np.ndarray:
    """Hashes of lower-cased words and of ends."""
    raw = np.frombuffer(b" ".join(b"." if w == END else w for w in words), np.uint8)
    h, _ = hash_words(raw, np.array([0, len(raw)]))
    h[[i for i, w in enumerate(words) if w == END]] = END_HASH
    return h


# ---------------------------------------------------------------- dictionary

def branches(weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A prefix code in the order of the leaves, by halving their weights: bits from the top of PATH_BITS, and how many."""
    n = len(weight)
    total = np.concatenate([[0], np.cumsum(weight)])
    path, depth = np.zeros(n, np.uint64), np.zeros(n, np.int64)
    lo, hi, bits = np.array([0]), np.array([n]), np.zeros(1, np.uint64)
    for d in range(PATH_BITS + 1):
        leaf = hi - lo == 1
        path[lo[leaf]], depth[lo[leaf]] = bits[leaf], d
        lo, hi, bits = lo[~leaf], hi[~leaf], bits[~leaf]
        if not len(lo):
            break
        half = (total[lo] + total[hi]) / 2
        at = np.searchsorted(total, half, "right") - 1  # the split below the half or the one above, whichever is nearer
        at += half - total[at] > total[np.minimum(at + 1, n)] - half
        at = np.clip(at, lo + 1, hi - 1)
        one = bits | np.uint64(1 << max(PATH_BITS - 1 - d, 0))
        lo, hi, bits = np.concatenate([lo, at]), np.concatenate([at, hi]), np.concatenate([bits, one])
    depth[lo] = PATH_BITS + 1  # not reached by as many bits
    for a, b in zip(lo.tolist(), hi.tolist()):
        depth[a:b] = PATH_BITS + 1
    return path, depth


class Dictionary:
    """Leaves in the order of their spellings: words, the end and the escape, with counts in training texts."""

    def __init__(self, counts: dict[bytes, int], ends: int, tokens: int, words: int):
        # words that came once tell how often a new one comes
        unknown = max(tokens - sum(counts.values()) - ends, 0) + sum(c == 1 for c in counts.values())
        leaves = {w + SPACE: c for w, c in counts.items()} | {END: ends, ESCAPE: unknown}
        while True:
            names = sorted(leaves)
            self.path, self.depth = branches(np.array([leaves[x] for x in names], np.int64) + 1)
            deep = np.flatnonzero(self.depth > PATH_BITS)
            if not len(deep):
                break
            for i in deep.tolist():  # spelled out instead
                leaves[ESCAPE] += leaves.pop(names[i])
        self.count = np.array([leaves[x] for x in names], np.int64)
        self.escape, self.end = names.index(ESCAPE), names.index(END)
        h = token_hashes([x[:-1] if x not in (END, ESCAPE) else END for x in names])
        order = np.argsort(h, kind="stable")
        order = order[order != self.escape]
        self.hashes, self.ranks = h[order], order.astype(np.int32)
        # where hashes with the same top bits begin
        self.top = np.searchsorted(self.hashes, np.arange(1 << RANK_BITS, dtype=np.uint64) << np.uint64(64 - RANK_BITS)).astype(np.int32)
        # leaves by how often they come, for short numbers on the way
        self.often = np.argsort(-self.count, kind="stable").astype(np.int32)
        self.place = np.empty(len(self.often), np.uint32)
        self.place[self.often] = np.arange(len(self.often))

    def rank(self, t: np.ndarray) -> np.ndarray:
        """The leaf of each token; the escape for words that are not in the dictionary."""
        most = len(self.hashes) - 1
        at = np.minimum(self.top[t >> np.uint64(64 - RANK_BITS)], most)
        left = np.flatnonzero(self.hashes[at] < t)
        while len(left):  # on among those with the same top bits
            at[left] += 1
            left = left[at[left] <= most]
            left = left[self.hashes[at[left]] < t[left]]
        at = np.minimum(at, most)
        return np.where(self.hashes[at] == t, self.ranks[at], self.escape).astype(np.int64)


# ---------------------------------------------------------------- counts along the bits of words

@dataclass
class Ways:
    """For each pair of a context and a leaf: what came of the leaf in the context, and where along its bits others part from it.

    ``edge`` says where the partings of each pair begin.
    """
    own: np.ndarray
    edge: np.ndarray
    depth: np.ndarray
    drop: np.ndarray

    def totals(self) -> np.ndarray:
        """How often each pair's context came."""
        fell = np.concatenate([[0], np.cumsum(self.drop, dtype=np.int64)])
        return self.own + fell[self.edge[1:]] - fell[self.edge[:-1]]

    def take(self, at: np.ndarray) -> "Ways":
        n = np.diff(self.edge)[at]
        edge = np.concatenate([[0], np.cumsum(n)])
        k = np.repeat(self.edge[:-1][at] - edge[:-1], n) + np.arange(edge[-1])
        return Ways(self.own[at], edge, self.depth[k], self.drop[k])


def smaller(w: Ways) -> Ways:
    """Counts of very frequent contexts scaled down together, none to 0, so that sums stay under 2^31."""
    total = w.totals()
    if not len(total) or total.max() < 1 << 30:
        return w
    by = np.maximum(1, total >> 29)
    return Ways(-(-w.own // by), w.edge, w.depth, -(-w.drop // np.repeat(by, np.diff(w.edge))))


def joined(a: Ways, b: Ways) -> Ways:
    return Ways(np.concatenate([a.own, b.own]), np.concatenate([a.edge, b.edge[1:] + a.edge[-1]]), np.concatenate([a.depth, b.depth]), np.concatenate([a.drop, b.drop]))


def partings(context: np.ndarray, path: np.ndarray) -> np.ndarray:
    """Of pairs in order: after how many bits each parts from the one before it; -1 in another context and at both ends."""
    part = np.full(len(path) + 1, -1, np.int64)
    if len(path) > 1:
        x = path[1:] ^ path[:-1]
        part[1:-1] = np.where(context[1:] == context[:-1], PATH_BITS - np.frexp(x.astype(np.float64))[1], -1)
    return part


def splits(part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where pairs of a context part: each first pair of a later side, where the other side begins, and where its own side ends."""
    later = np.flatnonzero(part[:-1] >= 0)
    begin, end = np.arange(-1, len(part) - 2), np.arange(1, len(part))
    for to in (begin, end):
        live = later
        while len(live):  # past pairs that part from their neighbours further on
            live = live[part[to[live]] > part[live]]
            to[live] = to[to[live]]
    return later, begin[later], end[later]


def places(w: Ways) -> np.ndarray:
    """A number in order for each parting: its pair and depth."""
    return np.repeat(np.arange(len(w.own)) << 6, np.diff(w.edge)) | w.depth


def unshared(w: Ways, part: np.ndarray) -> Ways:
    """Without what falls where a pair still goes with the one before it, which says the same, or where two sides part that are
    both here, as each then lacks what the other adds up to."""
    at = places(w)
    keep = w.depth > part[at >> 6]
    later, begin, _ = splits(part)
    gone = begin << 6 | part[later]
    i = np.searchsorted(at, gone)
    i = i[at[np.minimum(i, len(at) - 1)] == gone] if len(at) else i[:0]
    keep[i] = False
    return Ways(w.own, np.concatenate([[0], np.cumsum(np.bincount(at[keep] >> 6, minlength=len(w.own)))]), w.depth[keep], w.drop[keep])


def sides(w: Ways, part: np.ndarray, later: np.ndarray, begin: np.ndarray, end: np.ndarray) -> Ways:
    """With what both sides of each split lack, from the sums of what is said on the other one."""
    at = places(w)
    said = np.concatenate([[0], np.cumsum(w.drop, dtype=np.int64)])
    own = np.concatenate([[0], np.cumsum(w.own, dtype=np.int64)])
    upto = own + said[w.edge]
    left = own[later] - own[begin] + said[w.edge[later]] - said[np.searchsorted(at, begin << 6 | part[later])]
    at = np.concatenate([at, begin << 6 | part[later], later << 6 | part[later]])
    drop = np.concatenate([w.drop, upto[end] - upto[later], left])
    order = np.argsort(at)
    order = order[drop[order] > 0]
    at = at[order]
    return Ways(w.own, np.concatenate([[0], np.cumsum(np.bincount(at >> 6, minlength=len(w.own)))]), (at & 63).astype(np.uint8), drop[order].astype(w.drop.dtype))


def shared(w: Ways, part: np.ndarray) -> Ways:
    """The whole of what ``unshared`` left: at each depth a pair has what the last one before it says that did not go along."""
    later, begin, end = splits(part)
    w = sides(w, part, later, begin, end)
    # all that a pair has above its own parting, the pair before the split has too
    more = np.zeros(len(w.own), np.int64)
    more[later] = np.searchsorted(places(w), begin << 6 | part[later]) - w.edge[begin]
    said, turns, done = np.diff(w.edge), [], part[:-1] < 0
    while len(later):  # after those they have it from
        ready = done[begin]
        more[later[ready]] += more[begin[ready]]
        done[later[ready]] = True
        turns.append((later[ready], begin[ready]))
        later, begin = later[~ready], begin[~ready]
    edge = np.concatenate([[0], np.cumsum(said + more)])
    depth, drop = np.empty(edge[-1], np.uint8), np.empty(edge[-1], w.drop.dtype)
    to = np.repeat(edge[:-1] + more - w.edge[:-1], said) + np.arange(len(w.drop))
    depth[to], drop[to] = w.depth, w.drop
    for pair, source in turns:
        n = more[pair]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        to, of = np.repeat(edge[pair], n) + step, np.repeat(edge[source], n) + step
        depth[to], drop[to] = depth[of], drop[of]
    return Ways(w.own, edge, depth, drop)


def ways(context: np.ndarray, rank: np.ndarray, n: np.ndarray, path: np.ndarray) -> Ways:
    """Of distinct pairs in order, with their counts: all pairs are here, so nothing needs to be said."""
    return shared(Ways(n, np.zeros(len(rank) + 1, np.int64), np.zeros(0, np.uint8), np.zeros(0, n.dtype)), partings(context, path[rank]))


def level(total: np.ndarray) -> np.ndarray:
    out = np.zeros(len(total), np.uint8)
    for bound in _BOUNDS:
        out += total > bound
    return out


def chances(sources: list[tuple[Ways, np.ndarray, np.ndarray, np.ndarray]], bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every bit of tokens: the stretched chance of the leaf's own bit, and the level of its context's count; 0 both where no count is.

    bits: how many each token has. Sources: counts, and for some tokens their rows, which tokens they are, and what to leave out of
    each one's counts. Counts are under 2^31, so running sums may wrap around.
    """
    ends = np.cumsum(bits, dtype=np.int32)
    size = int(ends[-1]) if len(ends) else 0
    fall, total = np.zeros(size + 1, np.int32), np.zeros(len(bits), np.int32)
    for w, row, at, less in sources:
        first = w.edge[row]
        n = (w.edge[row + 1] - first).astype(np.int32)
        stops = np.cumsum(n, dtype=np.int32)
        k = np.repeat(first - (stops - n), n) + np.arange(stops[-1] if len(stops) else 0)
        fall[np.repeat((ends - bits)[at], n) + w.depth[k]] = w.drop[k]
        total[at] = w.own[row].astype(np.int32) - less
    miss = fall[:-1]
    upto = np.zeros(size + 1, np.int32)
    np.cumsum(miss, dtype=np.int32, out=upto[1:])
    total = np.repeat(total + upto[ends], bits)
    total -= upto[:-1]
    x = (total - miss).astype(np.float32) + np.float32(DELTA)
    x /= miss.astype(np.float32) + np.float32(DELTA)
    return np.log(x, out=x), level(total)


def stretched(w: Ways, row: np.ndarray, bits: np.ndarray, less: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``chances`` of rows of ``w``, all of which have counts."""
    return chances([(w, row, np.arange(len(row)), less)], bits)


# ---------------------------------------------------------------- spelled words

class Speller:
    """What the bytes of a word that is spelled out cost, from how many distinct training words hold them."""

    def __init__(self, two: np.ndarray, byte: np.ndarray, n: np.ndarray):
        def table(context, size):
            out = np.zeros((size, 257), np.int64)
            np.add.at(out, (context, byte + 1), n)
            return np.cumsum(out, axis=1)

        self.contexts = np.unique(two)
        self.tables = [table(np.zeros(len(two), np.int64), 1), table(two & 255, 256), table(np.searchsorted(self.contexts, two), len(self.contexts) + 1)]
        self.learn(two, byte, n)

    def bits(self, at: list[np.ndarray], byte: np.ndarray, less: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """[bytes, 8, MIXED] stretched chances of the bits of bytes in contexts (a row of each table), and gates."""
        x, gate = np.empty((len(byte), 8, MIXED), np.float32), np.empty((len(byte), 8), np.uint8)
        for m, (table, row) in enumerate(zip(self.tables, at)):
            for d in range(8):
                lo = byte >> (8 - d) << (8 - d)
                total = np.maximum(table[row, lo + (256 >> d)] - table[row, lo] - less, 0)
                lo = byte >> (7 - d) << (7 - d)
                hit = np.maximum(table[row, lo + (128 >> d)] - table[row, lo] - less, 0)
                x[:, d, m] = np.log((hit + DELTA) / (total - hit + DELTA))
                if m == 2:
                    gate[:, d] = _GATE[np.minimum(total, 255)]
        return x, gate

    def learn(self, two: np.ndarray, byte: np.ndarray, n: np.ndarray) -> None:
        """Weights from the counted bytes themselves, each without one occurrence; then the cost of every byte after every context."""
        start = np.tile(np.array([0.2, 0.4, 0.6]), (LEVELS, 1))
        found = []
        for i in range(0, len(two), 1 << 15):
            part = slice(i, i + (1 << 15))
            x, gate = self.bits([np.zeros(len(two[part]), np.int64), two[part] & 255, np.searchsorted(self.contexts, two[part])], byte[part], 1)
            found.append(added_up([x[:, :, m].reshape(-1) for m in range(MIXED)], gate.reshape(-1), LEVELS, np.repeat(n[part], 8)))
        w = learned_of_sums(*(sum(c) for c in zip(*found)), start) if found else start
        # contexts that never came have rows too: one for each last byte
        rows = np.concatenate([self.contexts, np.arange(256)])
        third = np.concatenate([np.arange(len(self.contexts)), np.full(256, len(self.contexts))])
        self.cost_of = np.empty((len(rows), 256), np.float32)
        for i in range(0, len(rows), 256):
            r = np.repeat(rows[i : i + 256], 256)
            x, gate = self.bits([np.zeros(len(r), np.int64), r & 255, np.repeat(third[i : i + 256], 256)], np.tile(np.arange(256), len(r) // 256))
            self.cost_of[i : i + 256] = (bit_costs((x * w[gate]).sum(2)).sum(1) / np.log(2)).reshape(-1, 256)
        self.row_of = np.concatenate([np.tile(len(self.contexts) + np.arange(256), 256)]).astype(np.int32)
        self.row_of[self.contexts] = np.arange(len(self.contexts))
        del self.tables

    def cost(self, word: pa.Array) -> np.ndarray:
        """Bits of each word."""
        raw, of = spelled_out(word)
        if not len(raw):
            return np.zeros(len(word))
        two = contexts_of(raw, of)
        first = np.flatnonzero(np.diff(of, prepend=-1))
        return np.add.reduceat(self.cost_of[self.row_of[two], raw].astype(np.float64), first)


def contexts_of(raw: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The two bytes before each byte of spelled words; spaces before the first."""
    one, two = np.full(len(raw), 32, np.int32), np.full(len(raw), 32, np.int32)
    one[1:], two[2:] = raw[:-1], raw[:-2]
    first = np.flatnonzero(np.diff(of, prepend=-1))
    one[first] = two[first] = 32
    second = first + 1
    second = second[second < len(raw)]
    two[second[of[second] == of[second - 1]]] = 32
    return two << 8 | one


def spelled_out(word: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of words, each followed by a space, and the word of each byte."""
    _, offs, data = word.buffers()
    off = np.frombuffer(offs, np.int32)[word.offset : word.offset + len(word) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    off -= off[0]
    of = np.repeat(np.arange(len(word)), np.diff(off) + 1)
    out = np.full(len(of), 32, np.uint8)
    keep = np.ones(len(of), bool)
    keep[off[1:] + np.arange(len(word))] = False
    out[keep] = raw
    return out, of


# ---------------------------------------------------------------- mixing

def bit_costs(z: np.ndarray) -> np.ndarray:
    """-ln of the logistic function."""
    return np.log1p(np.exp(-np.abs(z))) + np.maximum(-z, 0)


def learned(x: np.ndarray, gate: np.ndarray, start: np.ndarray, rounds: int = 6, ridge: float = 4.0, often: np.ndarray | float = 1.0) -> np.ndarray:
    """Weights per gate by Newton steps from ``start``, to which rare gates stay near; ``often``: how often each bit came."""
    w, g = start.astype(np.float64).copy(), len(start)
    for _ in range(rounds):
        z = np.clip((x * w[gate]).sum(1), -20, 20)
        p = 1 / (1 + np.exp(-z))
        slope, curve = often * (1 - p), often * p * (1 - p)
        grad = np.stack([np.bincount(gate, slope * x[:, i], g) for i in range(MIXED)], 1) - ridge * (w - start)
        hess = np.empty((g, MIXED, MIXED))
        for i in range(MIXED):
            for j in range(i, MIXED):
                hess[:, i, j] = hess[:, j, i] = np.bincount(gate, curve * x[:, i] * x[:, j], g)
        step = np.linalg.solve(hess + ridge * np.eye(MIXED), grad[:, :, None])[:, :, 0]
        w += np.clip(step, -0.5, 0.5)
    return w


def added_up(x: list[np.ndarray], gate: np.ndarray, gates: int, often: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Bits by gate and rounded chances: how many, and the sums of their chances."""
    cell = gate.astype(np.int32)
    for xi in x:
        cell *= STEPS
        cell += np.clip(xi * 2 + STEPS // 2, 0, STEPS - 1).astype(np.int32)
    size = gates * STEPS**MIXED
    n = np.bincount(cell, often, size)
    return n, np.stack([np.bincount(cell, xi if often is None else xi * often, size) for xi in x])


def learned_of_sums(n: np.ndarray, x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Weights from bits that were added up, each taken at the mean chances of its cell."""
    cell = np.flatnonzero(n)
    return learned((x[:, cell] / n[cell]).T, cell // STEPS**MIXED, start, often=n[cell].astype(np.float64))


#: What learning starts from: with an unseen context its predictor has no say.
PRIOR = np.array([[1.0 if not (a or b) else 0.5 if not (a and b) else 0.3, 0.5 if a else 0.0, 0.5 if b else 0.0] for a in range(LEVELS) for b in range(LEVELS)])


@dataclass
class Predictors:
    """For the tokens of some texts: their leaves' plain chances, and per context the counts along their bits."""
    bits: np.ndarray
    plain: np.ndarray  # where the leaf's chances begin
    chances: np.ndarray
    contexts: list[list[tuple[Ways, np.ndarray, np.ndarray, np.ndarray]]]  # of each predictor: counts; by token its row, what to leave out, and whether anything is left

    def slice(self, at: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Per predictor the chances of the bits of these tokens, their gates, and how many bits each token has."""
        n = self.bits[at]
        ends = np.cumsum(n, dtype=np.int32)
        size = int(ends[-1]) if len(ends) else 0
        x = [self.chances[np.repeat(self.plain[at] - (ends - n), n) + np.arange(size, dtype=np.int32)]]
        gate = np.zeros(size, np.uint8)
        for sources in self.contexts:
            few = []
            for found, row, less, known in sources:  # no token is known to two of them
                some = np.flatnonzero(known[at])
                few.append((found, row[at[some]], some, less[at[some]]))
            chance, levels = chances(few, n)
            x.append(chance)
            gate *= LEVELS
            gate += levels
        return x, gate, n


def mixed_cost(begin: np.ndarray, p: Predictors, start: np.ndarray) -> np.ndarray:
    """Bits of the dictionary's part of each text; the weights are refined in each text, block after block."""
    docs = len(begin) - 1
    size = np.diff(begin)
    cost = np.zeros(docs)
    order = np.argsort(-size, kind="stable")
    at = 0
    while at < docs:  # so many texts at once that a block of all of them stays small
        group = order[at : at + 64]
        at += len(group)
        w = [np.tile(start[:, i].astype(np.float32), len(group)) for i in range(MIXED)]
        lo, block = 0, FIRST_BLOCK
        while lo < size[group[0]]:
            live = int(np.searchsorted(-size[group], -lo, "left"))
            n = np.minimum(size[group[:live]] - lo, block)
            first = np.cumsum(n) - n
            tok = np.repeat(begin[group[:live]] + lo - first, n) + np.arange(n.sum())
            x, gate, bits = p.slice(tok)
            first = (np.cumsum(bits) - bits)[first]
            key = np.repeat(np.arange(live) * GATES, np.diff(np.append(first, len(gate)))) + gate
            z = x[0] * w[0].take(key)
            for xi, wi in zip(x[1:], w[1:]):
                z += xi * wi.take(key)
            e = np.exp(-np.abs(z))
            c = np.log(1 + e) + np.maximum(-z, 0)
            cost[group[:live]] += np.add.reduceat(c, first, dtype=np.float64)
            lo += block
            block = BLOCK
            on = int(np.searchsorted(-size[group], -lo, "left"))
            if not on:
                break
            upto = int(np.append(first, len(key))[on])  # texts that are over learn no more
            key, e, z = key[:upto], e[:upto], z[:upto]
            miss = np.where(z > 0, e, 1) / (1 + e)
            m = on * GATES
            size_of_step = RATE / (np.bincount(key, minlength=m) + 32)
            for xi, wi in zip(x, w):
                wi[:m] += size_of_step * np.bincount(key, miss * xi[:upto], m)
    return cost / np.log(2)


# ---------------------------------------------------------------- chunks and parts

def packed(*columns: np.ndarray) -> bytes:
    """Whole numbers, compressed byte by byte of their places, as high bytes are mostly zeros."""
    raw = b"".join(np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.dtype.itemsize).T).tobytes() for c in columns)
    return np.array([len(raw), *map(len, columns)], np.uint64).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(data: bytes, *kinds) -> list[np.ndarray]:
    size, *lens = np.frombuffer(data, np.uint64, 1 + len(kinds)).astype(int).tolist()
    raw = np.frombuffer(pa.decompress(data[8 + 8 * len(kinds) :], size, codec="zstd", asbytes=True) if size else b"", np.uint8)
    out, at = [], 0
    for n, kind in zip(lens, kinds):
        k = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(raw[at : at + n * k].reshape(k, n).T).reshape(-1).view(kind))
        at += n * k
    return out


def deltas(sorted_keys: np.ndarray) -> np.ndarray:
    return np.diff(sorted_keys, prepend=np.uint64(0))


def counted(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their weights."""
    u, at = np.unique(keys, return_inverse=True)
    return u, np.bincount(at, weights=weights, minlength=len(u)).astype(np.int64)


def came(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs in order and how often they came in training texts; pairs have fewer than 64 bits."""
    x = np.concatenate([np.zeros(0, np.uint64), *(k << np.uint64(1) | learn.astype(np.uint64) for k, learn in pairs)])
    x.sort()
    learn = (x & np.uint64(1)).astype(np.uint8)
    x >>= np.uint64(1)
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return x[first], np.add.reduceat(learn, first, dtype=np.int32) if len(x) else np.zeros(0, np.int32)


class Model:
    """What every executor has: the dictionary, the hot contexts, the speller, and how the exchange is cut."""

    def __init__(self, words: Dictionary, hot: np.ndarray, hot_pairs: np.ndarray, hot_counts: np.ndarray, speller: Speller, context_bits: int, parts: int, every_word: bool = False):
        self.words, self.hot, self.speller = words, hot, speller
        self.context_bits, self.parts, self.every_word = context_bits, parts, every_word
        self.hot_packed = packed(deltas(hot_pairs), hot_counts)  # sorted hot * 2^RANK_BITS + rank
        self.start = PRIOR
        self._plain = self._hot = None

    def plain(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and chances of every leaf's bits without a context."""
        if self._plain is None:
            d = self.words
            k = np.arange(len(d.count))
            most = max(1, int(d.count.sum()) >> 30)
            x, _ = stretched(ways(np.zeros(len(k), np.int64), k, -(-d.count // most), d.path), k, d.depth.astype(np.int32), np.zeros(len(k), np.int32))
            self._plain = (np.cumsum(d.depth) - d.depth).astype(np.int32), x
        return self._plain

    def keys(self, t: np.ndarray, begin: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By token: the pair with the last word, whether that is hot, and the pair with the last two words."""
        one, two = last_two(t, begin)
        at = np.minimum(np.searchsorted(self.hot, one), len(self.hot) - 1)
        hot = self.hot[at] == one
        shift, r = np.uint64(RANK_BITS), rank.astype(np.uint64)
        cut_to = np.uint64(64 - self.context_bits)
        a = mix64(one + np.uint64(1)) >> cut_to
        b = mix64(one * np.uint64(3) + mix64(two)) >> cut_to
        return np.where(hot, at.astype(np.uint64), a) << shift | r, hot, b << shift | r

    def asked(self, one: np.ndarray, hot: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs that the parts are asked for, and the token of each: those with two words, then those with a last word that is not hot."""
        if not self.every_word:
            return two, np.arange(len(two))
        cold = np.flatnonzero(~hot)
        return np.concatenate([two, one[cold]]), np.concatenate([np.arange(len(two)), cold])

    def edges(self, keys: np.ndarray) -> np.ndarray:
        """Where each part begins in sorted pairs; a part is a range of contexts."""
        bounds = np.array([(p << self.context_bits) // self.parts << RANK_BITS for p in range(1, self.parts)], np.uint64)
        return np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]])

    def ways(self, pairs: np.ndarray, counts: np.ndarray) -> Ways:
        d = self.words
        return ways(pairs >> np.uint64(RANK_BITS), (pairs & np.uint64((1 << RANK_BITS) - 1)).astype(np.int64), counts, d.path)

    def pack(self, pairs: np.ndarray) -> list[np.ndarray]:
        """Distinct pairs in order as columns: where a context begins, contexts, and the leaves, frequent ones by small numbers."""
        context = pairs >> np.uint64(RANK_BITS)
        new = np.diff(context, prepend=~np.uint64(0)) != 0
        return [np.packbits(new), deltas(context[new]), self.words.place[(pairs & np.uint64((1 << RANK_BITS) - 1)).astype(np.int64)]]

    def unpack(self, new: np.ndarray, context: np.ndarray, place: np.ndarray) -> np.ndarray:
        context = np.append(np.cumsum(context, dtype=np.uint64), np.uint64(0))[np.cumsum(np.unpackbits(new, count=len(place)), dtype=np.int64) - 1]
        return context << np.uint64(RANK_BITS) | self.words.often[place].astype(np.uint64)

    def found(self, asked: np.ndarray, learn: np.ndarray) -> tuple[Ways, np.ndarray, np.ndarray]:
        """Counts of asked pairs among themselves, their contexts' totals, and the row of each."""
        pair, row = np.unique(asked, return_inverse=True)
        found = self.ways(pair, np.bincount(row, learn, len(pair)).astype(np.int64))
        return found, found.totals(), row

    def partings(self, pairs: np.ndarray) -> np.ndarray:
        return partings(pairs >> np.uint64(RANK_BITS), self.words.path[(pairs & np.uint64((1 << RANK_BITS) - 1)).astype(np.int64)])

    def hot_ways(self, asked: np.ndarray) -> Ways:
        """Of asked hot pairs, whether they were counted or not."""
        if self._hot is None:
            pairs, counts = unpacked(self.hot_packed, np.uint64, np.int64)
            pairs, sums = np.cumsum(pairs, dtype=np.uint64), np.concatenate([[0], np.cumsum(counts)])
            counts = counts.astype(np.int32 if sums[-1] < 1 << 31 else np.int64)
            at = np.searchsorted(pairs, np.arange(len(self.hot) + 1, dtype=np.uint64) << np.uint64(RANK_BITS)).tolist()
            each = [self.ways(pairs[i:j], counts[i:j]) for i, j in zip(at, at[1:]) if j > i]
            steps = np.concatenate([np.zeros(0, np.int64), *(np.diff(w.edge) for w in each)])
            found = Ways(counts, np.concatenate([[0], np.cumsum(steps)]), *(np.concatenate([np.zeros(0, k), *(getattr(w, c) for w in each)]) for c, k in (("depth", np.uint8), ("drop", counts.dtype))))
            self._hot = pairs, found, sums
        pairs, found, sums = self._hot
        at = np.searchsorted(pairs, asked)
        came = pairs[np.minimum(at, len(pairs) - 1)] == asked if len(pairs) else np.zeros(len(asked), bool)
        new = asked[~came]
        # pairs that never came: what their contexts hold at each node on their way
        d = self.words
        rank = (new & np.uint64((1 << RANK_BITS) - 1)).astype(np.int64)
        base = new - rank.astype(np.uint64)
        total = np.zeros((len(new), int(d.depth.max()) + 1), np.int64)
        for k in range(total.shape[1]):
            step = np.uint64(1 << (PATH_BITS - k))
            lo = d.path[rank] // step * step
            i, j = (base + np.searchsorted(d.path, x).astype(np.uint64) for x in (lo, lo + step))
            total[:, k] = np.where(k < d.depth[rank], sums[np.searchsorted(pairs, j)] - sums[np.searchsorted(pairs, i)], 0)
        fell = total[:, :-1] - total[:, 1:]
        pair, depth = np.nonzero(fell)
        edge = np.concatenate([[0], np.cumsum(np.bincount(pair, minlength=len(new)))])
        row = np.empty(len(asked), np.int64)
        row[came], row[~came] = np.arange(came.sum()), came.sum() + np.arange(len(new))
        return smaller(joined(found.take(at[came]), Ways(np.zeros(len(new), np.int64), edge, depth.astype(np.uint8), fell[pair, depth])).take(row))


def _tally(hot: np.ndarray):
    """Training texts -> counts of words (p = -1) and of words after each hot one (its place)."""
    def run(batches):
        for batch in batches:
            for _, _, raw, off in runs(batch.column(0)):
                s, e, _ = word_spans(raw, off)
                t, begin = tokens(raw, off)
                one, _ = last_two(t, begin)
                word = t != END_HASH
                h, ends = t[word], one[~word]
                u, at, n = np.unique(h, return_index=True, return_counts=True)
                yield _rows(np.full(len(u), -1), spelled(raw, s[at], e[at]), n)
                place = np.minimum(np.searchsorted(hot, one), len(hot) - 1)
                k = np.flatnonzero((hot[place] == one)[word])
                place = place[word]
                _, at, n = np.unique(mix64(h[k] ^ (place[k].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))), return_index=True, return_counts=True)
                yield _rows(place[k][at], spelled(raw, s[k][at], e[k][at]), n)
                place = np.searchsorted(hot, ends)
                place = place[hot[np.minimum(place, len(hot) - 1)] == ends]
                p, n = np.unique(np.concatenate([np.full(len(ends), -1), place]), return_counts=True)
                yield _rows(p, pa.array([END] * len(p), pa.binary()), n)
            release()
    return run


def _rows(p, w, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), w, pa.array(n.astype(np.int64))], ["p", "w", "n"])


def _spellings(batches):
    """Distinct words -> (two bytes before, byte) counts."""
    for b in batches:
        raw, of = spelled_out(b.column(0).cast(pa.binary()))
        if not len(raw):
            continue
        u, n = np.unique(contexts_of(raw, of) << 8 | raw, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array((u >> 8).astype(np.int32)), pa.array((u & 255).astype(np.int32)), pa.array(n.astype(np.int64))], ["ctx", "byte", "n"])


def _sorted_counts(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return counted(np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts])) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def read_texts(model: Model, texts: pa.Array, train: np.ndarray):
    """Texts -> for every text its token hashes (whole texts, spelled costs and unknown words with it)."""
    d = model.words
    for i, j, raw, off in runs(texts):
        t, begin = tokens(raw, off)
        rank = d.rank(t)
        learn = np.repeat(train[i:j], np.diff(begin))
        # words that are not in the dictionary are spelled out here, each distinct one once
        out = np.flatnonzero(rank == d.escape)
        spelling = np.zeros(j - i)
        if len(out):
            s, e, _ = word_spans(raw, off)
            text = np.searchsorted(begin, out, "right") - 1
            word = out - text  # each text before it has an end among the tokens
            _, at, back = np.unique(t[out], return_index=True, return_inverse=True)
            cost = model.speller.cost(spelled(raw, s[word[at]], e[word[at]]))
            spelling = np.bincount(text, cost[back], j - i)
        yield i, j, t, begin, rank.astype(np.int32), learn, out, spelling, np.diff(off)


def _ask(model_of):
    """Texts -> rows for parts (their distinct pairs and rare words, with counts in training texts) and one for the chunk itself."""
    def run(batches):
        model: Model = model_of()
        task, number = TaskContext.get().partitionId(), 0
        held: list = []
        size = 0
        for b in batches:
            for k, *read in _reads(model, b):
                held.append((b.column(0).take(pa.array(np.arange(k, read[0]))), *read[1:]))  # not a slice, which would hold the batch
                size += int(read[-1].sum())
                if size >= model.chunk_bytes:
                    yield from _sent(model, held, task << 24 | number)
                    held, size, number = [], 0, number + 1
        if held:
            yield from _sent(model, held, task << 24 | number)
    return run


def _reads(model, b):
    train = b.column(2).to_numpy(zero_copy_only=False).astype(bool)
    yield from read_texts(model, b.column(1), train)


def _sent(model: Model, held: list, chunk: int):
    d = model.words
    pairs, tails = [], []
    for _, t, begin, rank, learn, out, *_ in held:
        c, of = model.asked(*model.keys(t, begin, rank))
        pairs.append((c, learn[of]))
        tails.append(counted(t[out], learn[out]))
    pair, n = came(pairs)
    word, m = _sorted_counts(tails)
    del pairs, tails
    edge = model.edges(pair).tolist()
    rare = np.searchsorted(word, np.array([(p << 64) // model.parts for p in range(1, model.parts)], np.uint64))
    rare = [0, *rare.tolist(), len(word)]
    ids = pa.concat_arrays([h[0] for h in held])
    rows, size = [], 0
    for p in range(model.parts):
        (a, b), (x, y) = edge[p : p + 2], rare[p : p + 2]
        if b > a or y > x:
            rows.append((p, packed(*model.pack(pair[a:b]), n[a:b].astype(np.uint32), deltas(word[x:y]), m[x:y].astype(np.uint32))))
            size += len(rows[-1][1])
        if rows and (size >= BATCH_BYTES or p == model.parts - 1):
            none = pa.nulls(len(rows), pa.list_(ids.type))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int64()), pa.array([chunk] * len(rows), pa.int64()), none, pa.array([x for _, x in rows], pa.binary())], ["key", "chunk", "ids", "data"])
            rows, size = [], 0
    del pair, n, word, m
    codes = d.place[np.concatenate([h[3] for h in held])]
    begin = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(h[2]) for h in held]))])
    data = packed(codes, np.concatenate([h[1][h[5]] for h in held]), np.diff(begin).astype(np.uint32), np.concatenate([h[4][h[2][:-1]] for h in held]).astype(np.uint8),
                  np.concatenate([h[6] for h in held]), np.concatenate([h[7] for h in held]).astype(np.uint64))
    own = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    held.clear()
    release()
    yield pa.RecordBatch.from_arrays([pa.array([-1 - chunk], pa.int64()), pa.array([chunk], pa.int64()), own, pa.array([data], pa.binary())], ["key", "chunk", "ids", "data"])


def _answer(model_of):
    """A part's pairs from all chunks -> for each chunk the counts along the bits of its pairs, in their order, and of its rare words.

    Pairs of a context of which all counts are the chunk's own are only marked, what a pair shares with the one before it is said once, and
    what the chunk can add up (its own counts, the sides of a split that has both) is left to it.
    """
    def run(key, asked):
        model: Model = model_of()
        blobs = [unpacked(x.as_py(), np.uint8, np.uint64, np.uint32, np.uint32, np.uint64, np.uint32) for x in asked.column("data")]
        blobs = [(model.unpack(*pairs), n, np.cumsum(words, dtype=np.uint64), m) for *pairs, n, words, m in blobs]
        u, back = np.unique(np.concatenate([k for k, *_ in blobs]), return_inverse=True)
        found = model.ways(u, np.bincount(back, weights=np.concatenate([n for _, n, *_ in blobs]), minlength=len(u)).astype(np.int64))
        total = _context_totals(u, found.own)
        back = back.astype(np.int32)
        words, at = np.unique(np.concatenate([w for *_, w, _ in blobs]), return_inverse=True)
        seen = np.bincount(at, weights=np.concatenate([m for *_, m in blobs]), minlength=len(words)).astype(np.uint32)
        out, x, y = [], 0, 0
        for k, n, w, _ in blobs:
            mine = back[x : x + len(k)]
            x += len(k)
            asks = total[mine] > _context_totals(k, n.astype(np.int64))
            part = unshared(smaller(found.take(mine[asks])), model.partings(k[asks]))
            out.append(packed(np.packbits(asks), part.own.astype(np.uint32) - n[asks], np.diff(part.edge).astype(np.uint8), part.depth, part.drop.astype(np.uint32), seen[at[y : y + len(w)]]))
            y += len(w)
        del blobs, back, found, total, words, at, seen
        release()
        return pa.table({"chunk": asked.column("chunk"), "part": pa.array([key[0].as_py()] * len(out), pa.int64()), "data": pa.array(out, pa.binary())})
    return run


def _context_totals(pairs: np.ndarray, n: np.ndarray) -> np.ndarray:
    if not len(pairs):
        return n
    ctx = pairs >> np.uint64(RANK_BITS)
    s = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]]))
    return np.repeat(np.add.reduceat(n, s), np.diff(np.append(s, len(ctx))))


def _merge(model: Model, pair: np.ndarray, n: np.ndarray, words: np.ndarray, answers: dict[int, bytes]) -> tuple[Ways, np.ndarray, np.ndarray]:
    """A chunk's pairs and rare words, and the answers of the parts -> counts along bits, totals of contexts, and counts of the words."""
    edge = model.edges(pair).tolist()
    rare = [0, *np.searchsorted(words, np.array([(p << 64) // model.parts for p in range(1, model.parts)], np.uint64)).tolist(), len(words)]
    known = np.zeros(len(words), np.int64)
    own, totals, steps, depth, drop = out = [np.empty(0, k) for k in (np.int32, np.int32, np.uint8, np.uint8, np.int32)]
    got, begin = [], 0
    for p in range(model.parts):
        (a, b), (x, y) = edge[p : p + 2], rare[p : p + 2]
        if b > a or y > x:
            marks, *columns, seen = unpacked(answers[p], np.uint8, np.uint32, np.uint8, np.uint8, np.uint32, np.uint32)
            asked = np.unpackbits(marks, count=b - a)
            if asked.sum() != len(columns[0]) or len(seen) != y - x:
                raise ValueError("an answer to other pairs")
            known[x:y] = seen
            got.append((asked, *columns))
        if got and (b - begin >= MERGED or p == model.parts - 1):
            w = _merged(model, pair[begin:b], n[begin:b], *map(np.concatenate, zip(*got)))
            for column, x in zip(out, (w.own, w.totals(), np.diff(w.edge), w.depth, w.drop)):
                at = len(column)
                column.resize(at + len(x), refcheck=False)  # in place, so that the whole is never held twice
                column[at:] = x
            got, begin = [], b
            del w, column, x
            release()
    edge = np.zeros(len(own) + 1, np.int64)
    np.cumsum(steps, out=edge[1:])
    return Ways(own, edge, depth, drop), totals, known


def _merged(model: Model, pair, n, asked, own, steps, depth, drop) -> Ways:
    """The answer where there is one, else the chunk's own counts: a context is either or."""
    asked = asked.astype(bool)
    mine = model.ways(pair[~asked], n[~asked])
    own = (own + n[asked].astype(np.uint32)).astype(np.int64)
    there = shared(Ways(own, np.concatenate([[0], np.cumsum(steps, dtype=np.int64)]), depth, drop.astype(np.int32)), model.partings(pair[asked]))
    order = np.empty(len(pair), np.int64)
    order[asked], order[~asked] = np.arange(len(own)), len(own) + np.arange(len(mine.own))
    return joined(there, mine).take(order)


def predictors(model: Model, t, begin, rank, learn, found_of) -> Predictors:
    """Chances for tokens; ``found_of(pairs, learn)`` gives the ways of pairs that are asked of the parts, with totals, and the row of each."""
    one, hot, two = model.keys(t, begin, rank)
    asked, of = model.asked(one, hot, two)
    found, totals, row = found_of(asked, learn[of])
    row, less = row.astype(np.int32), learn.astype(np.int32)
    warm, cold = np.flatnonzero(hot), of[len(t) :]
    asked, at = np.unique(one[warm], return_inverse=True)
    after = model.hot_ways(asked)

    def source(ways, total, tokens, rows):
        place, known = np.zeros(len(t), np.int32), np.zeros(len(t), bool)
        place[tokens] = rows
        known[tokens] = total[rows] > less[tokens]
        return ways, place, less, known

    last = [source(after, after.totals(), warm, at), *([source(found, totals, cold, row[len(t) :])] if len(cold) else [])]
    place, chances = model.plain()
    return Predictors(model.words.depth[rank].astype(np.int32), place[rank], chances, [last, [(found, row[: len(t)], less, totals[row[: len(t)]] > less)]])


def sliced(t, begin, rank, learn) -> list[tuple]:
    """Texts in slices of about SLICE tokens: the first and the last one of each, and what belongs to their tokens."""
    cuts = np.unique(np.concatenate([np.searchsorted(begin, np.arange(0, begin[-1], SLICE)), [len(begin) - 1]])).tolist()
    return [(i, j, t[begin[i] : begin[j]], begin[i : j + 1] - begin[i], rank[begin[i] : begin[j]], learn[begin[i] : begin[j]]) for i, j in zip(cuts, cuts[1:])]


def asked_of(model: Model, parts: list[tuple]):
    """The pairs that slices ask for, and whether each is learned from."""
    for *_, t, begin, rank, learn in parts:
        k, of = model.asked(*model.keys(t, begin, rank))
        yield k, learn[of]


def found_in(pair: np.ndarray, found: Ways, totals: np.ndarray):
    """For ``predictors``: counts of pairs in order, as they were found."""
    def found_of(asked, _):
        order, row = np.argsort(asked), np.empty(len(asked), np.int32)
        row[order] = np.searchsorted(pair, asked[order])
        return found, totals, row
    return found_of


def _chances(model_of):
    """Training texts -> their bits added up: contexts counted in chunks, the corpus' plain and hot counts."""
    def run(batches):
        model: Model = model_of()
        n, sums = np.zeros(GATES * STEPS**MIXED), np.zeros((MIXED, GATES * STEPS**MIXED))
        held, size = [], 0

        def chunk():
            t = np.concatenate([t for t, _ in held])
            begin = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(x) for _, x in held]))])
            held.clear()
            parts = sliced(t, begin, model.words.rank(t).astype(np.int32), np.ones(len(t), bool))
            pair, count = came(asked_of(model, parts))
            # some contexts at a time
            context = pair >> np.uint64(RANK_BITS)
            cuts = np.unique(np.append(np.searchsorted(context, context[::MERGED]), len(pair))).tolist()
            ways = [model.ways(pair[i:j], count[i:j]) for i, j in zip(cuts, cuts[1:])]
            edge = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(w.edge) for w in ways]))])
            found = Ways(count, edge, *(np.concatenate([getattr(w, c) for w in ways]) for c in ("depth", "drop")))
            totals = np.concatenate([w.totals() for w in ways])
            del ways, context
            for *_, t, begin, rank, learn in parts:
                p = predictors(model, t, begin, rank, learn, found_in(pair, found, totals))
                for i in range(0, len(t), 1 << 14):
                    x, gate, _ = p.slice(np.arange(i, min(i + (1 << 14), len(t))))
                    for total, more in zip((n, sums), added_up(x, gate, GATES)):
                        total += more
            release()

        for b in batches:
            for i, j, raw, off in runs(b.column(0)):
                held.append(tokens(raw, off))
                size += len(raw)
                if size >= LEARNED_BYTES:
                    chunk()
                    size = 0
        if held:
            chunk()
        cell = np.flatnonzero(n)
        # whole numbers, whose sums do not depend on the order they come in
        yield pa.RecordBatch.from_arrays([pa.array(cell), *(pa.array(np.rint(c[cell]).astype(np.int64)) for c in (n, *(sums * UNIT)))], ["cell", "n", "x0", "x1", "x2"])
    return run


def learned_start(texts: DataFrame, model_of) -> np.ndarray:
    """Starting weights from all training texts. A fixed number of sums comes to the driver."""
    found = map_arrow(texts, _chances(model_of), "cell long, n long, x0 long, x1 long, x2 long").groupBy("cell").agg(*(F.sum(c).alias(c) for c in ("n", "x0", "x1", "x2"))).orderBy("cell").toArrow()
    n, x = np.zeros(GATES * STEPS**MIXED), np.zeros((MIXED, GATES * STEPS**MIXED))
    cell = found["cell"].to_numpy()
    n[cell] = found["n"].to_numpy()
    for i in range(MIXED):
        x[i, cell] = found[f"x{i}"].to_numpy() / UNIT
    return learned_of_sums(n, x, PRIOR)


def _score(model_of):
    def run(key, rows, answers):
        model: Model = model_of()
        d = model.words
        names = ["id", "n_tokens", "n_known", "base", "bits", "n_bytes"]
        data = {p: x.as_buffer() for p, x in zip(answers.column("part").to_pylist(), answers.column("data"))}
        ids = rows.column("ids").combine_chunks().flatten()
        model.plain(), model.hot_ways(np.zeros(0, np.uint64))  # made by the worker's first task, before it holds much
        codes, tail, size, train, spelling, n_bytes = unpacked(rows.column("data")[0].as_py(), np.uint32, np.uint64, np.uint32, np.uint8, np.float64, np.uint64)
        rank = d.often[codes]
        del codes
        begin = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        learn = np.repeat(train.astype(bool), size)
        # any hash does for a dictionary word but its own: contexts are hashes of tokens
        own = np.zeros(len(d.count), np.uint64)
        own[d.ranks] = d.hashes
        t = own[rank]
        out = np.flatnonzero(rank == d.escape)
        t[out] = tail
        words, back = np.unique(tail, return_inverse=True)
        parts = sliced(t, begin, rank, learn)
        pair, n = came(asked_of(model, parts))
        release()
        found, totals, known = _merge(model, pair, n, words, data)
        del n, data
        found_of = found_in(pair, found, totals)
        bits = spelling.copy()
        for i, j, *slice in parts:
            bits[i:j] += mixed_cost(slice[1], predictors(model, *slice, found_of), model.start)
        count = d.count[rank]
        count[out] = known[back]
        at = begin[:-1]
        base = np.add.reduceat(np.log10(count + 0.5), at)
        release()
        return pa.table([ids, pa.array(size.astype(np.int64)), pa.array(np.add.reduceat((count > 0).astype(np.int64), at)), pa.array(base), pa.array(bits), pa.array(n_bytes.astype(np.int64))], names)
    return run


def score_texts(docs: DataFrame, training, id_col: str = "doc_id", text_col: str = "text", every_word: bool = False) -> DataFrame:
    """Scores of every row, the model learned from rows for which ``training`` (a column) is true.

    Columns: id, n_tokens, n_known, train_tokens, base_score, score (both log10), bits, n_bytes, bits_per_byte.
    A training row is predicted without the very occurrences that are predicted; base_score is not.
    With ``every_word`` each last word is a context by itself, else only HOT very frequent ones are.
    Nulls: a null text is empty and has the end alone; a null id stays null. Repeated rows count as
    often as they come. Without training rows every token is unknown. Empty tables give empty ones.
    Rows are read twice and have to come in the same order, so ``docs`` should be files.
    """
    spark = docs.sparkSession
    ship(spark)
    base = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"), F.coalesce(training, F.lit(False)).alias("train"))
    kind = docs.schema[id_col].dataType.simpleString()
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    sample = _sampled(base)
    hot = _frequent(sample)
    counts = cut(map_arrow(base.filter("train").select("text"), _tally(hot), "p int, w binary, n long").groupBy("p", "w").agg(F.sum("n").alias("c")))
    vocab = counts.filter("p = -1")
    n, v = (int(x or 0) for x in vocab.agg(F.sum("c"), F.count("*")).first())
    ends = vocab.filter(F.col("w") == F.lit(bytearray(END))).select("c").collect()  # one row
    ends = int(ends[0][0]) if ends else 0
    # the dictionary: a fixed number of words
    top = vocab.filter(F.col("w") != F.lit(bytearray(END))).orderBy(F.desc("c"), "w").limit(HEAD).select("w", "c").toArrow()
    head = dict(zip(top["w"].to_pylist(), top["c"].to_pylist()))
    words = Dictionary(head, ends, n, v)
    # words after hot ones: at most HOT times the dictionary's leaves
    names = spark.createDataFrame(top.select(["w"])).withColumn("in", F.lit(True))
    after = counts.filter("p >= 0").join(F.broadcast(names), "w", "left")
    after = after.groupBy("p", F.when(F.col("in") | (F.col("w") == F.lit(bytearray(END))), F.col("w")).alias("w")).agg(F.sum("c").alias("c")).toArrow()
    coded = after["w"].combine_chunks().dictionary_encode()
    rank = words.rank(token_hashes(coded.dictionary.to_pylist()))
    rank = np.append(rank, words.escape)[coded.indices.fill_null(len(rank)).to_numpy()]
    hot_pairs, hot_counts = counted(after["p"].to_numpy().astype(np.uint64) << np.uint64(RANK_BITS) | rank.astype(np.uint64), after["c"].to_numpy())
    # two bytes and the next one: bounded by the alphabet
    letters = map_arrow(vocab.filter(F.col("w") != F.lit(bytearray(END))).select("w"), _spellings, "ctx int, byte int, n long").groupBy("ctx", "byte").agg(F.sum("n").alias("n")).toArrow()
    speller = Speller(*(letters[c].to_numpy().astype(np.int64) for c in ("ctx", "byte", "n")))
    bits = min(44, max(24, int(np.ceil(np.log2(size + 2))) + 3))
    grown = min(GROWN, max(1.0, (size / 1e9) ** 0.5))
    parts = int(min(1 << 16, max(4, -(-size // (PART_BYTES * grown)))))
    model = Model(words, hot, hot_pairs, hot_counts, speller, bits, parts, every_word)
    model.chunk_bytes = CHUNK_BYTES * max(1.0, grown / 4)
    shared = spark.sparkContext.broadcast(model)
    # no more tasks than there are chunks, as contexts in small ones are seldom known
    start = model.start = learned_start(base.filter("train").select("text").coalesce(max(1, -(-size // LEARNED_BYTES))), lambda: shared.value)

    def model_of():
        found = shared.value
        found.start = start
        return found

    rows = map_arrow(base, _ask(model_of), f"key long, chunk long, ids array<{kind}>, data binary").repartition(parts, "key")  # one exchange, read twice
    # never 1: Catalyst moves no filter with it below the exchange, which then would not be shared
    nil = F.rand(0).cast("long")
    answers = rows.filter(F.col("key") >= nil).groupBy("key").applyInArrow(_answer(model_of), "chunk long, part long, data binary").withColumn("key", -1 - F.col("chunk"))
    out = rows.filter(F.col("key") < nil).groupBy("key").cogroup(answers.groupBy("key")).applyInArrow(_score(model_of), f"id {kind}, n_tokens long, n_known long, base double, bits double, n_bytes long")
    whole = float(np.log10(n + 0.5 * (v + 1)))
    return out.select(
        "id", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * whole).alias("base_score"),
        (-F.col("bits") * float(np.log10(2))).alias("score"), "bits", "n_bytes", F.when(F.col("n_bytes") > 0, F.col("bits") / F.col("n_bytes")).alias("bits_per_byte"))


def _sampled(base: DataFrame) -> pa.Array:
    """At most SAMPLE_TEXTS training texts and SAMPLE_BYTES of them, by a hash: for the choice of hot words only."""
    few = base.filter(F.col("train") & (F.length("text") < SAMPLE_BYTES // 16)).select("text").orderBy(F.xxhash64("text", F.lit(3)), "text").limit(SAMPLE_TEXTS).toArrow()["text"].combine_chunks()
    upto = int(np.searchsorted(np.cumsum([len(x.as_buffer()) for x in few]), SAMPLE_BYTES)) if len(few) else 0
    return few.slice(0, upto + 1)


def _frequent(sample: pa.Array) -> np.ndarray:
    """Hashes of the most frequent words of the sample, and of the beginning of a text."""
    h = [hash_words(raw, off)[0] for _, _, raw, off in runs(sample)]
    u, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *h]), return_counts=True)
    return np.sort(np.append(u[np.lexsort((u, -n))[: HOT - 1]], BOS))


def query(docs: DataFrame) -> DataFrame:
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")), F.lit(5)) == 1
    out = score_texts(docs, ~held, every_word=True).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
