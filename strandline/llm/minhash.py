"""MinHash near-duplicates with sequential Bayesian verification.

1. A text's distinct word shingles give ``BANDS * ROWS`` minima, and a bucket key for every band.
   Texts with the same set of shingles are one class from here on (its smallest id stands for it).
2. Star pairs: the members of a bucket meet its smallest member, so a bucket costs its size.
3. Signatures of a pair are compared batch by batch. With a uniform prior on the similarity the
   posterior after m of n agreements is Beta(m + 1, n - m + 1); a pair is dropped as soon as its
   posterior chance to reach the threshold is under ``miss``.
4. Survivors are verified on their full sets.
5. Buckets whose members are in different components by then are gone through again: the members
   outside the bucket's largest component meet all its members, block against block for large ones,
   signatures and sets at hand. Pairs across components are pruned in the same way, and the survivors
   verified from the most similar one down, skipping those connected meanwhile. A pair is looked at in
   the first bucket that it shares, and none is capped; only links leave the task. With S members, m of
   them outside the largest component, this takes S * m comparisons and 2 * S * m / BLOCK rows.

Components come from alternating large-star and small-star steps on the verified links.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import map_arrow
from .common import cut, drop_ids, hash_shingles, hash_words, maybe_broadcast, mix64, runs, text_or_empty

ROWS, BANDS = 5, 25
HASHES, BATCH = 128, 32
MISS = 1e-4
#: Members of one block, and bytes of their sets, when a large bucket is compared block against block.
BLOCK, BLOCK_BYTES = 2048, 16 << 20
#: Members of a hub that are verified in one task.
HUB = 4096

_rng = np.random.RandomState(20)
_A = (_rng.randint(0, 2**31, HASHES).astype(np.uint32) * np.uint32(2)) | np.uint32(1)
_B = _rng.randint(0, 2**31, HASHES).astype(np.uint32) * np.uint32(2) + np.uint32(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minima of HASHES hash functions over each (non-empty) set."""
    out = np.empty((len(sets), HASHES), np.uint32)
    i = 0
    while i < len(sets):
        j, size = i, 0
        while j < len(sets) and (j == i or size + len(sets[j]) <= 4096):
            size += len(sets[j])
            j += 1
        x = np.concatenate(sets[i:j])
        x = (x >> np.uint64(32)).astype(np.uint32)
        at = np.cumsum([0, *(len(s) for s in sets[i : j - 1])])
        for k in range(0, HASHES, 16):
            v = x[None, :] * _A[k : k + 16, None]
            v += _B[k : k + 16, None]
            v ^= v >> np.uint32(16)
            v *= np.uint32(0x85EBCA6B)
            out[i:j, k : k + 16] = np.minimum.reduceat(v, at, axis=1).T
        i = j
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(sig), BANDS), np.uint64)
    for b in range(BANDS):
        h = np.full(len(sig), b + 1, np.uint64)
        for r in range(ROWS):
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, b * ROWS + r])
        keys[:, b] = h
    return keys.view(np.int64)


def least_matches(threshold: float, miss: float = MISS) -> dict[int, int]:
    """After n comparisons, the fewest agreements with which a pair may still reach the threshold.

    P(J >= t | m of n) under a uniform prior is P(Binomial(n + 1, t) <= m).
    """
    out = {}
    for n in range(BATCH, HASHES + 1, BATCH):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def may_reach(a: np.ndarray, b: np.ndarray, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """For rows of a and b: which survive every batch, and their agreements."""
    live, same = np.arange(len(a)), np.zeros(len(a), np.int32)
    for n, m in least.items():
        if not len(live):
            break
        same[live] += (a[live, n - BATCH : n] == b[live, n - BATCH : n]).sum(1, dtype=np.int32)
        live = live[same[live] >= m]
    return live, same


def _sketch(k: int):
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for i, j, raw, off in runs(batch.column(1)):
                sets = hash_shingles(*hash_words(raw, off), k)
                full = [x for x, s in enumerate(sets) if len(s)]
                sig = signatures([sets[x] for x in full])
                keys = bands(sig)
                n = len(sets)
                a, b = np.zeros(n, np.int64), np.zeros(n, np.int64)
                for x in full:
                    s = sets[x]
                    a[x] = s.sum(dtype=np.uint64).view(np.int64)
                    b[x] = mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)
                row = dict(zip(full, range(len(full))))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array(a), pa.array(b),
                     pa.array([sig[row[x]].tobytes() if x in row else None for x in range(n)], pa.binary()),
                     pa.array([keys[row[x]] if x in row else None for x in range(n)], pa.list_(pa.int64()))],
                    ["id", "n", "a", "b", "sig", "keys"])
    return run


def _prune(least: dict[int, int]):
    """Pairs with both signatures -> pairs that may reach the threshold."""
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint32).reshape(-1, HASHES) for c in ("sig_u", "sig_v"))
            live, _ = may_reach(x, y, least)
            t = pa.Table.from_batches([b.select(["u", "v"])]).take(pa.array(live))
            yield from t.to_batches()
    return run


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many elements two sorted sets have in common."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def _verify(percent: int):
    """Rows ordered so that a set comes before those to compare it with -> links."""
    def run(batches):
        own, now = None, None
        for b in batches:
            u, v, sets = b.column("u").to_pylist(), b.column("v").to_pylist(), b.column("set")
            links: list[tuple[int, int]] = []
            for x, y, s in zip(u, v, sets):
                s = np.frombuffer(s.as_buffer(), np.uint64)
                if y is None:
                    own, now = s, x
                elif now == x:
                    both = _shared(s, own)
                    if 100 * both >= percent * (len(s) + len(own) - both):
                        links.append((x, y))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in links], pa.int64()) for i in (0, 1)], ["u", "v"])
    return run


def _shingle_sets(k: int):
    def run(batches):
        for batch in batches:
            for i, j, raw, off in runs(batch.column(1)):
                sets = hash_shingles(*hash_words(raw, off), k)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "set"])
    return run


class _Forest:
    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        r = x
        while self.up.get(r, r) != r:
            r = self.up[r]
        while self.up.get(x, x) != r:
            self.up[x], x = r, self.up[x]
        return r

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _across(least: dict[int, int], percent: int):
    """Members of a bucket (or of two of its blocks), grouped -> verified links across components."""
    def candidates(key, pivot, major, ids, comp, sig, keys, block):
        """Pairs whose first common bucket this is, that may reach the threshold, with agreements."""
        band = int(np.flatnonzero(keys[0] == key)[0])
        own, other = np.flatnonzero(block == 0), np.flatnonzero(block == 1)
        for x in own.tolist():
            if ids[x] == pivot:
                continue  # met every member already
            # of two members outside the largest component, one meets the other
            y = other[(comp[other] != comp[x]) & (ids[other] != pivot) & ((comp[other] == major) | (ids[other] > ids[x]))]
            if band and len(y):
                y = y[~(keys[y, :band] == keys[x, :band]).any(1)]
            if len(y):
                live, same = may_reach(np.broadcast_to(sig[x], (len(y), HASHES)), sig[y], least)
                if len(live):
                    yield np.full(len(live), x), y[live], same[live]

    def group(key, rows) -> list[tuple[int, int]]:
        pivot, major, ids, comp, block = (np.array([r[k] for r in rows], np.int64) for k in range(5))
        if len(np.unique(comp)) < 2:
            return []
        sig = np.frombuffer(b"".join(r[5] for r in rows), np.uint32).reshape(-1, HASHES)
        keys = np.array([r[6] for r in rows], np.int64)
        found = list(candidates(key, pivot[0], major[0], ids, comp, sig, keys, block))
        if not found:
            return []
        x, y, same = (np.concatenate(c) for c in zip(*found))
        forest, links, sets = _Forest(), [], {}
        for i in np.argsort(-same, kind="stable").tolist():
            a, b = int(x[i]), int(y[i])
            if forest.root(int(comp[a])) == forest.root(int(comp[b])):
                continue
            for r in (a, b):
                if r not in sets:
                    sets[r] = np.frombuffer(rows[r][7], np.uint64)
            both = _shared(sets[a], sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                forest.join(int(comp[a]), int(comp[b]))
                links.append((int(ids[a]), int(ids[b])))
        return links

    def run(batches):
        now, rows = None, []

        def out(found):
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], ["u", "v"])

        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("key", "i", "j", "pivot", "major", "id", "comp", "block", "sig", "keys", "set")]
            for key, i, j, *r in zip(*cols):
                if (key, i, j) != now:
                    if len(rows) > 1:
                        yield out(group(now[0], rows))
                    now, rows = (key, i, j), []
                rows.append(r)
        if len(rows) > 1:
            yield out(group(now[0], rows))
    return run


def _contract(batches):
    """Links of a task -> a star around the smallest id of each of its components."""
    forest = _Forest()
    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            forest.join(u, v)
    pairs = [(r, x) for x in forest.up if (r := forest.root(x)) != x]
    for i in range(0, len(pairs), 100_000):
        part = pairs[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in part], pa.int64()) for k in (0, 1)], ["u", "v"])


def components(links: DataFrame, limit: int = 60) -> DataFrame:
    """(u, v) -> id, comp: the smallest id that each linked one reaches."""
    few = 2 * links.sparkSession.sparkContext.defaultParallelism

    def keep(df):  # narrow rows: no more files than the cluster has use for
        return cut(df.coalesce(few))

    edges = keep(map_arrow(links, _contract, "u long, v long"))
    for _ in range(limit):
        # large star: every larger neighbour to the smallest one around
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = keep(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.filter("v > u").join(maybe_broadcast(least), "u").select(F.col("m").alias("u"), "v").filter("u <> v")
        large = keep(map_arrow(large, _contract, "u long, v long"))
        # small star: every smaller neighbour to the smallest one
        least = keep(large.groupBy("v").agg(F.min("u").alias("m"), F.max("u").alias("top")))
        if not least.filter("m < top").limit(1).count():
            centres = least.select("m").distinct()
            if not centres.join(least, centres.m == least.v, "left_semi").limit(1).count():
                return least.select(F.col("v").alias("id"), F.col("m").alias("comp")).union(centres.select("m", "m"))
        small = large.join(maybe_broadcast(least), "v").select(F.col("m"), F.explode(F.array("u", "v")).alias("w")).filter("m <> w")
        edges = keep(small.select(F.col("m").alias("u"), F.col("w").alias("v")).distinct())
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, k: int = 5) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Links: 100 * |A & B| >= percent * |A | B| on the sets of k-word shingles; sets are compared as
    64-bit hashes. Nulls: a null or wordless text has no set and is its own component; a null id
    takes no part and is kept, with a null component. Rows with one id are one document; if their
    texts differ, one of them stands for it in comparisons. Empty tables give empty tables.
    """
    least = least_matches(percent / 100)
    base = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    sk = cut(map_arrow(base, _sketch(k), "id long, n long, a long, b long, sig binary, keys array<long>"))
    linked = sk.filter("n > 0 and id is not null")
    classes = cut(linked.groupBy("a", "b", "n").agg(F.min("id").alias("rep"), F.max("id").alias("last")).filter("rep <> last").drop("last"))
    rows = sk.select("id", "n", "a", "b").join(maybe_broadcast(classes), ["a", "b", "n"], "left")
    rows = rows.select("id", "n", F.coalesce("rep", "id").alias("rep"))
    others = linked.select("id", "a", "b", "n").join(maybe_broadcast(classes), ["a", "b", "n"]).filter("id <> rep").select("id")
    # one row for each class; equal ids with different texts meet here
    reps = drop_ids(linked.select("id", "n", "sig", "keys"), others, "id")

    exploded = reps.select("id", "n", F.explode("keys").alias("key"))
    crowded = cut(exploded.groupBy("key").agg(F.min("id").alias("pivot"), F.count("*").alias("size")).filter("size > 1"))
    members = cut(exploded.join(crowded, "key"))
    ids = cut(members.select("id").distinct())
    few = maybe_broadcast(ids, 2_000_000)
    sigs = cut(reps.select("id", "sig", "keys").join(few, "id", "left_semi").dropDuplicates(["id"]))
    sets = cut(map_arrow(base.join(few, "id", "left_semi"), _shingle_sets(k), "id long, set binary").filter(F.length("set") > 0).dropDuplicates(["id"]))

    def verified(pairs: DataFrame) -> DataFrame:
        hubs = cut(pairs.groupBy("u").count().filter(F.col("count") > HUB))
        pairs = pairs.join(maybe_broadcast(hubs), "u", "left").withColumn("chunk", F.pmod(F.xxhash64("v"), F.coalesce(F.ceil(F.col("count") / HUB), F.lit(1)))).drop("count")
        right = pairs.join(sets, pairs.v == sets.id).select("u", "chunk", "v", "set")
        left = pairs.select("u", "chunk").distinct().join(sets, F.col("u") == sets.id).select("u", "chunk", F.lit(None).cast("long").alias("v"), "set")
        both = left.union(right).repartition("u", "chunk").sortWithinPartitions("u", "chunk", F.col("v").asc_nulls_first())
        return map_arrow(both, _verify(percent), "u long, v long")

    def pruned(pairs: DataFrame) -> DataFrame:
        p = pairs.join(sigs.select(F.col("id").alias("v"), F.col("sig").alias("sig_v")), "v")
        return map_arrow(p.join(sigs.select(F.col("id").alias("u"), F.col("sig").alias("sig_u")), "u"), _prune(least), "u long, v long")

    stars = members.filter("id <> pivot").select(F.col("pivot").alias("u"), F.col("id").alias("v")).distinct()
    links = cut(verified(cut(pruned(stars))))
    labels = cut(components(links))
    named = cut(members.filter("size > 2").join(maybe_broadcast(labels), "id", "left").withColumn("comp", F.coalesce("comp", "id")))
    apart = cut(named.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 <> c1").select("key"))
    if apart.limit(1).count():
        spread = cut(named.join(maybe_broadcast(apart), "key", "left_semi"))
        # the largest component of each bucket, and how many blocks its members and those outside of it make
        sizes = spread.groupBy("key", "comp").agg(F.count("*").alias("n"), F.sum("n").alias("bytes"))
        sizes = sizes.groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("major"), F.sum("n").alias("all"), F.max("n").alias("most"), F.sum("bytes").alias("bytes"))
        blocks = [F.ceil(F.greatest(m / BLOCK, F.col("bytes") * 8 * m / F.col("all") / BLOCK_BYTES)).cast("int") for m in (F.col("all") - F.col("most"), F.col("all"))]
        sizes = cut(sizes.select("key", "major", blocks[0].alias("few"), blocks[1].alias("many")))
        spread = spread.select("key", "pivot", "id", "comp").join(maybe_broadcast(sizes), "key")

        def dealt(rows, side, own, other, n_own, n_other):
            return rows.withColumn(own, F.pmod(F.xxhash64("id", F.lit(side)), F.col(n_own)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(n_other) - 1))).withColumn("block", F.lit(side))

        spread = dealt(spread.filter("comp <> major"), 0, "i", "j", "few", "many").unionByName(dealt(spread, 1, "j", "i", "many", "few")).drop("few", "many")
        spread = spread.join(sigs, "id").join(sets, "id").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
        more = cut(map_arrow(spread, _across(least, percent), "u long, v long"))
        if more.limit(1).count():
            labels = cut(components(links.union(more)))
    out = rows.join(maybe_broadcast(labels), rows.rep == labels.id, "left").select(
        rows.id.alias("doc_id"), rows.n.alias("n_shingles"), F.coalesce(labels.comp, rows.rep).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay: the smallest id of each component."""
    gone = near_duplicates(docs, id_col, text_col).filter("not kept").select(F.col("doc_id").alias(id_col))
    return drop_ids(docs, gone, id_col)
