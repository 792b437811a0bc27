"""Quality grades by ordinal cumulative-link regression on hashed text.

P(grade <= k) = logistic(cut_k - w.x): one weight vector shared by all grades, and ordered cuts.
Features are hashed from the bytes: words (lower-cased, without the punctuation around them), their
beginnings, their shapes (runs of capitals, other letters, digits and each other character), and the
marks at their ends. Fitted on the driver on a bounded sample of rated rows,
whose features are hashed where the text lies; applied to all texts in one pass.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import map_arrow
from .common import cut, mix64, runs, text_or_empty, word_spans

BUCKETS = 1 << 18
#: Rated rows used for fitting, at most (taken by a hash of their identifier).
MAX_RATED = 12_000
GRADES = 3
BEGINNINGS = (4, 5, 6, 7)
#: A text is selected if its chance of the asked grade is at least this; under a half, as losing a clean text costs more.
CHANCE = 0.4
_BASE = np.uint64(0xC2B2AE3D27D4EB4F)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: What a byte counts as in a shape: a capital, another letter (all of other scripts), a digit, other scripts' punctuation, or itself.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[128:], _CLASS[48:58] = 1, 2, 2, 3
_OTHER_MARK = 4
_powers: list[np.ndarray] = [np.ones(1, np.uint64)] * 2


def _sums(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of values times powers (of their place), and the inverse powers."""
    n = len(values) + 1
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, _BASE_INV)):
            p = np.full(max(n, 1 << 21), b, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    out = np.zeros(n, np.uint64)
    terms = (values.astype(np.uint64) + np.uint64(1)) * _powers[0][: n - 1]
    np.cumsum(terms, out=out[1:])
    return out, _powers[1]


def _bucket(h: np.ndarray, kind: int, share: bool) -> np.ndarray:
    h = mix64(h + np.uint64(kind * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    return (h >> np.uint64(64 - 17)).view(np.int64) * 2 + share


def _same_length(c: str) -> str:
    low = c.lower()
    return low if len(low.encode("utf-8", "surrogatepass")) == len(c.encode("utf-8", "surrogatepass")) else c


def folded(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes lower-cased in place (a letter whose small form has another length stays), and their classes."""
    cls = _CLASS[raw]
    if not len(raw) or raw.max() < 128:
        return _LOWER[raw], cls
    text = raw.tobytes().decode("utf-8", "surrogatepass")
    low = text.lower().encode("utf-8", "surrogatepass")
    if len(low) != len(raw):
        small = {c: _same_length(c) for c in set(text)}
        low = "".join(map(small.__getitem__, text)).encode("utf-8", "surrogatepass")
    # quotes, dashes, ellipses and the like: U+00A0-00BF, U+2000-206F, U+3000-303F, U+FF01-FF0F
    a, b, c = raw, np.append(raw[1:], 0), np.append(raw[2:], [0, 0])[: len(raw)]
    two = np.flatnonzero((a == 0xC2) & ~np.isin(b, (0xAA, 0xB5, 0xBA)))
    three = np.flatnonzero((a == 0xE2) & ((b == 0x80) | (b == 0x81)) | (a == 0xE3) & (b == 0x80) | (a == 0xEF) & (b == 0xBC) & (c <= 0x8F))
    for at, n in ((two, 2), (three, 3)):
        for k in range(n):
            cls[at + k] = _OTHER_MARK
    return np.frombuffer(low, np.uint8), cls


def run_features(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a run of texts: (text, bucket) of every feature of every word, and the words of each text.

    A word has these features: itself from its first letter to its last, its beginnings of a few
    bytes, its shape (byte classes, repeats once), and up to three marks at its end. The first two are
    even buckets and count once a text, the others odd ones and count by their share.
    """
    starts, ends, first = word_spans(raw, off)
    words = np.diff(first)
    doc = np.repeat(np.arange(len(words)), words)
    if not len(starts):
        return doc, doc, words
    low, cls = folded(raw)
    text, inv = _sums(low)
    letters = np.flatnonzero((cls == 1) | (cls == 2))
    mark = cls > 3
    i, j = np.searchsorted(letters, starts), np.searchsorted(letters, ends)
    has = j > i
    a, b = starts.copy(), ends.copy()
    a[has], b[has] = letters[i[has]], letters[j[has] - 1] + 1
    docs, buckets = [doc], [_bucket((text[b] - text[a]) * inv[a], 1, False)]
    for k in BEGINNINGS:
        at = np.flatnonzero(b - a > k)
        docs.append(doc[at])
        buckets.append(_bucket((text[a[at] + k] - text[a[at]]) * inv[a[at]], 10 + k, False))
    turns = np.ones(len(raw), bool)
    turns[1:] = cls[1:] != cls[:-1]
    turns[starts] = True
    at = np.flatnonzero(turns)
    shape, inv = _sums(cls[at])
    i, j = np.searchsorted(at, starts), np.searchsorted(at, ends)
    docs.append(doc)
    buckets.append(_bucket((shape[j] - shape[i]) * inv[i], 2, True))
    at = np.flatnonzero(mark[ends - 1])
    e = ends[at]
    s = e - 1
    for _ in range(2):
        s = np.where((s > starts[at]) & mark[np.maximum(s - 1, 0)], s - 1, s)
    docs.append(doc[at])
    buckets.append(_bucket((text[e] - text[s]) * _powers[1][s], 3, True))
    return np.concatenate(docs), np.concatenate(buckets), words


def valued(doc: np.ndarray, bucket: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, value), each pair once: a half for what counts once, else twice the root of the share."""
    key, n = np.unique(doc * BUCKETS + bucket, return_counts=True)
    doc, bucket = key // BUCKETS, key % BUCKETS
    return doc, bucket, np.where(bucket % 2 == 1, 2 * np.sqrt(n / np.maximum(words[doc], 1)), 0.5)


@dataclass
class Ordinal:
    weights: np.ndarray
    cuts: np.ndarray

    def tails(self, z: np.ndarray) -> np.ndarray:
        """[rows, grades - 1]: P(grade > k)."""
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - z[:, None], -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], grades: int = GRADES, steps: int = 12000, rate: float = 2.0, l1: float = 1e-3, seed: int = 5) -> Ordinal:
    """(feature indices, values, grade) -> weights and ordered cuts.

    Weights by regularised dual averaging with adaptive steps: those whose mean gradient stays under
    ``l1`` are zero, which leaves a few hundred. Cuts are a first one and positive distances, so they
    stay ordered. Rarer grades weigh more.
    """
    rng = np.random.RandomState(seed)
    total, squares, t, batch = np.zeros(BUCKETS), np.full(BUCKETS, 1e-4), 0, 32
    share = np.bincount([r[2] for r in rows], minlength=grades) + 1.0
    below = np.cumsum(share)[:-1] / share.sum()
    cuts = np.log(below / (1 - below))
    par = np.concatenate([cuts[:1], np.log(np.maximum(np.diff(cuts), 0.1))])
    par_squares = np.full(len(par), 1e-6)
    weight = (share.sum() / (grades * share)) ** 0.5

    def weights(f):
        return -rate * np.sign(total[f]) * np.maximum(np.abs(total[f]) - l1 * t, 0) / np.sqrt(squares[f])

    def ordered():
        return np.concatenate([par[:1], par[0] + np.cumsum(np.exp(par[1:]))])

    def logistic(x):
        return 1 / (1 + np.exp(-np.clip(x, -35, 35)))

    while t < steps:
        order = rng.permutation(len(rows))
        for at in np.array_split(order, max(1, len(order) // batch)):
            idx = np.concatenate([rows[i][0] for i in at])
            val = np.concatenate([rows[i][1] for i in at])
            of = np.repeat(np.arange(len(at)), [len(rows[i][0]) for i in at])
            y = np.array([rows[i][2] for i in at])
            z = np.bincount(of, weights=weights(idx) * val, minlength=len(at))
            edge = np.concatenate([[-40.0], ordered(), [40.0]])
            up, lo = logistic(edge[y + 1] - z), logistic(edge[y] - z)
            share_of = weight[y] / len(at) / np.maximum(up - lo, 1e-9)
            d_up, d_lo = share_of * up * (1 - up), share_of * lo * (1 - lo)  # of the log likelihood, by the upper and lower edge
            f, inv = np.unique(idx, return_inverse=True)
            g = np.bincount(inv, weights=(d_up - d_lo)[of] * val)
            total[f] += g
            squares[f] += g * g
            t += 1
            by_cut = np.zeros(grades - 1)
            np.add.at(by_cut, np.minimum(y, grades - 2), np.where(y < grades - 1, d_up, 0))
            np.add.at(by_cut, np.maximum(y - 1, 0), np.where(y > 0, -d_lo, 0))
            g = np.concatenate([[by_cut.sum()], [by_cut[k:].sum() * np.exp(par[k]) for k in range(1, grades - 1)]])
            par_squares += g * g
            par += 0.1 * g / np.sqrt(par_squares)
    return Ordinal(weights(np.arange(BUCKETS)), ordered())


def grade() -> Column:
    """Of a rated row: 0 poor, 1 sound but toxic, 2 sound and clean; none if a rating it needs is null."""
    return F.when(F.col("quality").isNull() | (F.col("quality") > 0) & F.col("toxic").isNull(), None).when(F.col("quality") <= 0, 0).when(F.col("toxic") >= 1, 1).otherwise(2)


def train(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_RATED) -> Ordinal:
    """ratings: id and grade. Rows without a grade or a text take no part; of several grades the lowest counts.

    With fewer than two grades there is nothing to learn, and every text with a word is selected.
    """
    rated = ratings.filter(F.col("grade").isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min("grade").cast("int").alias("grade"))
    rated = cut(rated.orderBy(F.xxhash64("id", F.lit(11)), "id").limit(most))
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).join(F.broadcast(rated), "id")

    def features(batches):
        for b in batches:
            for i, j, raw, off in runs(b.column(0)):
                doc, bucket, value = valued(*run_features(raw, off))
                edge = pa.array(np.searchsorted(doc, np.arange(j - i + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [b.column(1).slice(i, j - i), pa.ListArray.from_arrays(edge, pa.array(bucket.astype(np.int32))), pa.ListArray.from_arrays(edge, pa.array(value.astype(np.float32)))], ["grade", "f", "v"])

    rows = map_arrow(texts.select("text", "grade"), features, "grade int, f array<int>, v array<float>").toArrow()  # `most` rows at most
    got = [(f.values.to_numpy().astype(np.int64), v.values.to_numpy().astype(np.float64), g) for g, f, v in zip(rows["grade"].to_pylist(), rows["f"], rows["v"]) if len(f)]
    if len({g for *_, g in got}) < 2:
        return Ordinal(np.zeros(BUCKETS), np.array([-2.0, -1.0]))
    return fit(got)


def grades(docs: DataFrame, model: Ordinal, id_col: str = "doc_id", text_col: str = "text", at_least: int = 2, chance: float = CHANCE) -> DataFrame:
    """One row per input row: id, expected_grade, tail_probability (of ``at_least``), kept.

    Nulls: a null or wordless text has no feature and the grade of the cuts alone; it is not kept. A
    null id stays null. Repeated rows return as often as they come, empty tables give empty tables.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.cuts))

    def run(batches):
        own = Ordinal(*shared.value)
        weighty = own.weights != 0
        for b in batches:
            for i, j, raw, off in runs(b.column(1)):
                doc, bucket, words = run_features(raw, off)
                keep = weighty[bucket]
                doc, bucket, value = valued(doc[keep], bucket[keep], words)
                t = own.tails(np.bincount(doc, weights=own.weights[bucket] * value, minlength=j - i))
                kept = (t[:, at_least - 1] >= chance) & (words > 0)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(t.sum(1)), pa.array(t[:, at_least - 1]), pa.array(kept)], ["id", "expected_grade", "tail_probability", "kept"])

    base = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    return map_arrow(base, run, f"id {kind}, expected_grade double, tail_probability double, kept boolean")


def selected(docs: DataFrame, model: Ordinal, text_col: str = "text", at_least: int = 2, chance: float = CHANCE) -> DataFrame:
    """The rows whose text is likely enough of that grade, with exactly the columns they came with."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("text"))
    kept = grades(rows, model, "row", "text", at_least, chance).filter("kept")
    return kept.select(*[F.col(f"id.`{c}`").alias(c) for c in docs.columns])


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(docs, labels.withColumn("grade", grade()))
    return grades(docs, model).withColumnRenamed("id", "doc_id")
