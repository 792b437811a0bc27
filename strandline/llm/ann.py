"""Approximate nearest neighbours by a permutation index.

Every vector is represented by the order of its nearest pivots and posted, with its place, in the
inverted files of the first POSTED of them. A query asks the files of its first ASKED pivots. What it
meets there is ranked by the footrule distance of the two orders as far as they are posted (a pivot
that one of them lacks counts as just behind its end), and the best SHARE are reranked by their
Euclidean distance on the original vectors.

Vectors lie in blocks of a fixed number of rows, each with its own inverted files, and queries in
blocks of a fixed number of bytes. Every block of queries meets every block of vectors in a task of
its own, which returns the best ``k`` of each query; nothing but counts and pivots crosses the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import ship

#: Pivots, first ones by which a vector is posted, and first ones that a query asks.
PIVOTS, POSTED, ASKED = 1024, 24, 48
#: Rows from which pivots are drawn, at most.
SAMPLE = 4096
#: Share of a block's vectors that are reranked, at most.
SHARE = 0.15
BLOCK_ROWS, QUERY_BYTES = 8192, 16 << 20


def usable(embedding: str = "embedding"):
    """Not null, not zero, and all components finite numbers."""
    x = F.col(embedding)
    return x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)


def choose_pivots(sample: np.ndarray, n: int, seed: int = 3) -> np.ndarray:
    """Pivots far from each other: each next one is the best of a few by its distance to those chosen."""
    rng = np.random.RandomState(seed)
    order = rng.permutation(len(sample))
    sample = np.unique(sample[order], axis=0)
    sample = sample[rng.permutation(len(sample))]
    if len(sample) <= n:
        return sample
    chosen = [0]
    near = ((sample - sample[0]) ** 2).sum(1)
    for _ in range(n - 1):
        few = rng.choice(len(sample), 12, replace=False)
        best = int(few[np.argmax(near[few])])
        chosen.append(best)
        near = np.minimum(near, ((sample - sample[best]) ** 2).sum(1))
    return sample[chosen]


def orders(x: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """The nearest pivots of each row, nearest first."""
    d = (pivots**2).sum(1)[None, :] - 2 * (x @ pivots.T)
    length = min(length, len(pivots))
    part = np.argpartition(d, length - 1, axis=1)[:, :length]
    return np.take_along_axis(part, np.argsort(np.take_along_axis(d, part, 1), axis=1, kind="stable"), 1).astype(np.int32)


class Block:
    """Vectors with the inverted files of their first pivots."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, pivots: np.ndarray, posted: int = POSTED, asked: int = ASKED):
        self.ids, self.x, self.pivots, self.asked = ids, x, pivots, min(asked, len(pivots))
        first = orders(x, pivots, posted)
        self.posted = first.shape[1]
        at = np.argsort(first.ravel(), kind="stable")
        edge = np.searchsorted(first.ravel()[at], np.arange(len(pivots) + 1))
        row, place = at // self.posted, (at % self.posted).astype(np.int16)
        self.files = [(row[a:b], place[a:b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]

    def ranked(self, order: np.ndarray, share: float = SHARE) -> tuple[np.ndarray, int]:
        """Rows met by a query's order, those with the least footrule distance (ties at the edge stay), and how many were met."""
        # a shared pivot brings the orders nearer by what both would count without it
        near = np.zeros(len(self.ids), np.int32)
        for place, pivot in enumerate(order.tolist()):
            rows, places = self.files[pivot]
            near[rows] += (self.asked - place) + (self.posted - places) - np.abs(places - place)
        met = np.flatnonzero(near)
        most = max(1, int(np.ceil(share * len(self.ids))))
        if len(met) > most:
            edge = np.partition(near[met], len(met) - most)[len(met) - most]
            return met[near[met] >= edge], len(met)
        return met, len(met)

    def search(self, qid: np.ndarray, q: np.ndarray, k: int, share: float = SHARE):
        """(query, id, distance) rows: the k nearest found for each query."""
        out_q, out_v, out_d = [], [], []
        for i, order in enumerate(orders(q, self.pivots, self.asked)):
            c, _ = self.ranked(order, share)
            if (self.ids[c] != qid[i]).sum() < k:  # too few to answer with: all take part
                c = np.arange(len(self.ids))
            c = c[self.ids[c] != qid[i]]
            d = np.sqrt(((self.x[c] - q[i]) ** 2).sum(1))
            if len(c) > k:
                edge = np.partition(d, k - 1)[k - 1]
                c, d = c[d <= edge], d[d <= edge]
            best = np.lexsort((self.ids[c], d))[:k]
            out_q.append(np.full(len(best), qid[i]))
            out_v.append(self.ids[c[best]])
            out_d.append(d[best])
        return tuple(np.concatenate(o) if o else np.zeros(0) for o in (out_q, out_v, out_d))


def _array(col: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding",
            pivots: int = PIVOTS, posted: int = POSTED, asked: int = ASKED, share: float = SHARE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: for each query its k nearest vectors other than its own row.

    Vectors that are null, zero, or hold a null or non-finite component take no part, nor do those
    of another dimension than the most frequent one (the smaller of two) or with a null id. Ties go to the
    smaller id. With fewer than k candidates all are returned; an empty table gives an empty one.
    Rows with one id are the same vector's rows and each is a candidate of other queries.
    """
    spark = vectors.sparkSession

    def clean(df):
        return df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("x")).filter(usable("x") & F.col("id").isNotNull())

    base, ask = clean(vectors), clean(queries)
    dims = base.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if dims is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, rows = dims
    base, ask = base.filter(F.size("x") == dim), ask.filter(F.size("x") == dim).dropDuplicates(["id"])
    sample = base.orderBy(F.xxhash64("id", F.lit(5)), "id").limit(SAMPLE).select("x").toArrow()  # a fixed number of rows
    index = spark.sparkContext.broadcast(choose_pivots(_array(sample["x"].combine_chunks(), dim), pivots))
    n_query = max(1, -(-ask.count() // max(1, QUERY_BYTES // (8 * dim))))
    n_vector = max(1, -(-rows // block_rows))

    def every(n):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    base = base.withColumn("v", F.pmod(F.monotonically_increasing_id(), F.lit(n_vector)).cast("int")).withColumn("q", every(n_query))
    ask = ask.withColumn("q", F.pmod(F.xxhash64("id", F.lit(9)), F.lit(n_query)).cast("int")).withColumn("v", every(n_vector))

    def answer(left, right):
        ids, qid = (t.column("id").to_numpy() for t in (left, right))
        found = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if len(ids) and len(qid):
            x, q = (_array(t.column("x").combine_chunks(), dim) for t in (left, right))
            found = Block(ids, x, index.value, posted, asked).search(qid, q, k, share)
        return pa.table([pa.array(c.astype(t)) for c, t in zip(found, (np.int64, np.int64, np.float64))], ["query_id", "vec_id", "score"])

    ship(spark)
    found = base.groupBy("v", "q").cogroup(ask.groupBy("v", "q")).applyInArrow(answer, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(embeddings: DataFrame) -> DataFrame:
    return nearest(embeddings, embeddings.filter(F.col("vec_id") % 100 == 0))
