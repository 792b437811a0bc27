"""Chaining of anchors: a grouped kernel per query and target strand.

Anchors of a query on one strand of a target are in one group; seeds too frequent to be of use are left out before (see
``seeding.anchors``), which bounds a group by the query's length times the cap.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import map_arrow, ship, tasks


@dataclass(frozen=True)
class ChainOptions:
    max_dist_x: int = 5000
    max_dist_y: int = 5000
    bw: int = 500
    max_iter: int = 5000
    min_cnt: int = 3
    min_score: int = 40
    gap: float = 0.8 * 0.01 * 15
    skip: float = 0.0
    spliced: bool = False
    max_drop: int | None = None
    segments: int = 1


def gap_limits(short_reads: bool, fragment: bool, max_gap: int, max_gap_ref: int, max_frag: int, query_length: int) -> tuple[int, int]:
    """Largest distances between two anchors of a chain, on the query and on the target."""
    if short_reads:
        on_query = max(query_length, max_gap)
        on_target = max_gap_ref if max_gap_ref > 0 else max(max_frag - query_length if max_frag > query_length and fragment else 0, max_gap)
        return on_query, on_target
    return max_gap, max_gap_ref if max_gap_ref > 0 else max_gap


def link_scores(q, t, span, seg, i: int, lo: int, o: ChainOptions) -> np.ndarray:
    """What anchor i adds when it follows each of the anchors lo..i-1; minus infinity where it cannot. Groups may be rows of arrays."""
    dq, dr = q[..., i, None] - q[..., lo:i], t[..., i, None] - t[..., lo:i]
    same = seg[..., lo:i] == seg[..., i, None]
    d = np.abs(dr - dq)
    bad = (dq <= 0) | (dq > o.max_dist_x) | same & ((dr == 0) | (dq > o.max_dist_y) | (d > o.bw) | (o.segments > 1 and not o.spliced) & (dr > o.max_dist_y))
    least = np.minimum(dq, dr)
    span = span[..., lo:i]
    sc = np.minimum(span, least).astype(np.float64)
    linear = o.gap * d + o.skip * least
    log = np.where(d >= 1, np.log2(d + 1.0), 0.0)
    free = o.spliced & (dr > dq) | ~same
    cost = np.where(free, np.minimum(linear, log), linear + 0.5 * log)
    # ends of segments that overlap on the target are worth a little instead of costing
    sc = np.where(~same & (dr == 0), sc + 1, np.where((d > 0) | (least > span), sc - np.trunc(cost), sc))
    return np.where(bad, -np.inf, sc)


def best_scores(q, t, span, seg, o: ChainOptions) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor (in target order) the best chain that ends there, and the anchor before it."""
    n = len(q)
    f, before = span.astype(np.float64).copy(), np.full(n, -1)
    lo = 0
    for i in range(n):
        while t[i] - t[lo] > o.max_dist_x:
            lo += 1
        a = max(lo, i - o.max_iter)
        if a < i:
            s = f[a:i] + link_scores(q, t, span, seg, i, a, o)
            k = len(s) - 1 - int(np.argmax(s[::-1]))
            if s[k] > f[i]:
                f[i], before[i] = s[k], a + k
    return f, before


def best_scores_of_groups(q, t, span, seg, o: ChainOptions) -> tuple[np.ndarray, np.ndarray]:
    """``best_scores`` of many groups at once, which are the rows of arrays; what fills a row up stands behind its anchors and follows none.

    Largest distances of ``o`` may differ by row (columns of one number).
    """
    f, before = span.astype(np.float64).copy(), np.full(q.shape, -1)
    row = np.arange(len(q))
    for i in range(1, q.shape[1]):
        a = max(0, i - o.max_iter)
        if a == i:
            continue
        s = f[:, a:i] + link_scores(q, t, span, seg, i, a, o)
        s[t[:, i, None] - t[:, a:i] > o.max_dist_x] = -np.inf
        k = s.shape[1] - 1 - np.argmax(s[:, ::-1], axis=1)
        better = s[row, k] > f[:, i]
        f[better, i], before[better, i] = s[row, k][better], a + k[better]
    return f, before


def best_scores_by_range(q, t, span, o: ChainOptions) -> tuple[np.ndarray, np.ndarray]:
    """The same for long gaps: no band, and every earlier anchor within reach counts, found by range maxima.

    Anchors stand in a tree in the order of their diagonals, with the best score of each range of them. What a link
    adds is at most the earlier anchor's span less the cost of the distance of diagonals, so a range that cannot beat
    the best link so far is left out whole; the more promising of two ranges is looked at first. The result is that of scoring all
    earlier anchors, in a time that grows with the logarithm of their number as long as scores rise along chains.
    """
    n = len(q)
    f, before = [float(x) for x in span], [-1] * n
    if n < 2:
        return np.array(f), np.array(before, np.int64)
    reach, gap, skip, free = int(o.max_dist_x), float(o.gap), float(o.skip), bool(o.spliced)
    order = np.lexsort((np.arange(n), t - q))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    size = 1 << (n - 1).bit_length()
    least_q, most_q = np.full(2 * size, np.iinfo(np.int64).max), np.full(2 * size, np.iinfo(np.int64).min)  # query places of each range
    least_q[size : size + n] = most_q[size : size + n] = q[order]
    half = size
    while half > 1:
        half >>= 1
        least_q[half : 2 * half] = least_q[2 * half : 4 * half].reshape(-1, 2).min(1)
        most_q[half : 2 * half] = most_q[2 * half : 4 * half].reshape(-1, 2).max(1)
    least_q, most_q = least_q.tolist(), most_q.tolist()
    diagonal, order, place = (t - q)[order].tolist(), order.tolist(), place.tolist()
    qs, ts, spans = q.tolist(), t.tolist(), span.tolist()
    top = [-np.inf] * (2 * size)  # the best score plus span of each range
    log2 = [0.0, *np.log2(np.arange(1, 4097) + 1.0).tolist()]

    def put(x: int, value: float) -> None:
        x += size
        top[x] = value
        x >>= 1
        while x:
            m = max(top[2 * x], top[2 * x + 1])
            if top[x] == m:
                break
            top[x] = m
            x >>= 1

    lo = there = 0
    for i in range(n):
        while there < i and ts[there] < ts[i]:  # anchors of one place are no predecessors of each other
            put(place[there], f[there] + spans[there])
            there += 1
        while ts[i] - ts[lo] > reach:
            if lo < there:
                put(place[lo], -np.inf)
            lo += 1
        d, best, link = ts[i] - qs[i], f[i], -1
        todo = [(1, 0, size)]
        while todo:
            x, a, b = todo.pop()
            if top[x] <= best:
                continue
            if x >= size:
                j = order[a]
                dq, dr = qs[i] - qs[j], ts[i] - ts[j]
                if dq <= 0 or dq > reach:
                    continue
                wide, least = abs(dr - dq), min(dq, dr)
                s = min(spans[j], least)
                if wide or least > spans[j]:
                    line = gap * wide + skip * least
                    log = 0.0 if not wide else log2[wide] if wide < 4097 else float(np.log2(wide + 1.0))
                    s -= int(min(line, log) if free and dr > dq else line + 0.5 * log)
                if f[j] + s > best:
                    best, link = f[j] + s, j
                continue
            m = (a + b) >> 1
            sides = []
            for y, u, v in ((2 * x, a, m), (2 * x + 1, m, b)):
                if top[y] > best and least_q[y] < qs[i] and most_q[y] >= qs[i] - reach:
                    first, last = diagonal[u], diagonal[min(v, n) - 1]
                    near = first - d if d < first else d - last if d > last else 0
                    cost = near * gap
                    if free and d > last:  # gaps of the query cost no more than a logarithm
                        cost = min(cost, log2[near] if near < 4097 else float(np.log2(near + 1.0)))
                    bound = top[y] - int(cost)
                    if bound > best:
                        sides.append((bound, y, u, v))
            sides.sort()
            todo.extend(x[1:] for x in sides)
        f[i], before[i] = best, link
    return np.array(f), np.array(before, np.int64)


def backtrack(f: np.ndarray, before: np.ndarray, o: ChainOptions) -> list[tuple[float, list[int]]]:
    """Chains by falling score, of equal ones from the later anchor first; a walk ends where the score has
    fallen too far below its best. An anchor is walked over once only, also by a chain that is too poor to keep."""
    drop = np.inf if o.spliced else (o.max_drop if o.max_drop is not None else o.bw)
    used, out = np.zeros(len(f), bool), []
    for end in np.lexsort((-np.arange(len(f)), -f)).tolist():
        if used[end] or f[end] < o.min_score:
            continue
        walk, x = [], end
        best, best_len = -np.inf, 0
        while x >= 0 and not used[x]:
            walk.append(x)
            nxt = before[x]
            left = 0.0 if nxt < 0 else f[nxt]
            gained = f[end] - left
            if gained > best:
                best, best_len = gained, len(walk)
            elif best - gained > drop:
                break
            x = nxt
        walk = walk[:best_len]
        used[walk] = True
        if len(walk) >= o.min_cnt and best >= o.min_score:
            out.append((best, walk[::-1]))
    return out


#: Groups of up to so many anchors are scored together, so many pairs of anchors at once.
SMALL_GROUP, PAIRS_AT_ONCE = 64, 1 << 20
#: A query is chained again with a wider band if its best chain leaves so many bases, or covers so much of it.
UNCOVERED, COVERED = 1000, 0.1
ANCHOR = "struct<tpos:long,qpos:long,span:int>"
CHAIN = f"qid long, tid long, rev int, chain long, score long, cnt long, qs long, qe long, rs long, re long, mlen long, blen long, places array<{ANCHOR}>"


def chain_rows(anchors: DataFrame, options: ChainOptions = ChainOptions(), long_gaps: bool = False, limits=None, wider: int = 0) -> DataFrame:
    """(qid, tid, rev, tpos, qpos, span) -> one row per chain: its number by falling score in the query, score, extent,
    matched and block length (see ``regions.summarise_chains``) and anchors.

    A group is a query's anchors on a target's strand; chains are numbered over the query afterwards. With a
    column ``length`` of the query, ``limits`` gives the largest distances for it (see ``gap_limits``), and chains
    of a group that leave much of the query uncovered are chained again with a band of ``wider``.
    """
    has = [c for c in ("seg", "length") if c in anchors.columns]
    columns = ["qid", "tid", "rev", "tpos", "qpos", "span", *has]

    def chained(q, t, span, seg, o, long_gaps):
        f, before = best_scores_by_range(q, t, span, o) if long_gaps else best_scores(q, t, span, seg, o)
        return backtrack(f, before, o)

    def limited(length):
        on_query, on_target = limits(length)
        return max(on_target, on_query), on_query

    def group(c: dict[str, np.ndarray], scored=None) -> list[tuple]:
        q, t, span = c["qpos"], c["tpos"], c["span"]
        seg = c["seg"] if "seg" in c else np.zeros(len(q), np.int64)
        length = int(c["length"][0]) if "length" in c else 0
        o = options
        if limits is not None:
            x, y = limited(length)
            o = replace(options, max_dist_x=x, max_dist_y=y)
        found = backtrack(*scored, o) if scored else chained(q, t, span, seg, o, long_gaps)
        if wider > options.bw and len(found) > 1:
            covered = int(q[found[0][1][-1]] - q[found[0][1][0]])
            if length - covered > UNCOVERED or covered > length * COVERED:
                used = np.sort(np.concatenate([w for _, w in found]))
                q, t, span, seg = q[used], t[used], span[used], seg[used]
                found = chained(q, t, span, seg, replace(o, bw=wider, max_dist_x=max(o.max_dist_x, wider), max_drop=wider), True)
        rows = []
        for s, w in found:
            a, b, n = q[w], t[w], span[w]
            dq, dt = np.diff(a), np.diff(b)
            mlen = n[0] + np.minimum(np.minimum(dq, dt), n[1:]).sum()
            rows.append((*(int(c[k][0]) for k in ("qid", "tid", "rev")), 0, int(s), len(w), int((a - n + 1).min()), int(a.max() + 1), int((b - n + 1).min()), int(b.max() + 1), int(mlen), int(n[0] + np.maximum(dq, dt).sum()),
                         [{"tpos": int(y), "qpos": int(x), "span": int(z)} for x, y, z in zip(a, b, n)]))
        return rows

    schema = pa.schema([*((n, pa.int32() if n == "rev" else pa.int64()) for n in ("qid", "tid", "rev", "chain", "score", "cnt", "qs", "qe", "rs", "re", "mlen", "blen")),
                        ("places", pa.list_(pa.struct([("tpos", pa.int64()), ("qpos", pa.int64()), ("span", pa.int32())])))])

    def some(c, a, b):
        """Rows of the groups between a and b, which begin where a key changes."""
        key = np.stack([c[k][a:b] for k in ("qid", "tid", "rev")])
        edge = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1, [b - a]]) + a
        most = np.add.reduceat(c["span"][a:b], edge[:-1] - a)  # no chain scores more than its spans
        first, size = edge[:-1], np.diff(edge)
        todo = np.flatnonzero((size >= options.min_cnt) & (most >= options.min_score))
        scored = {} if long_gaps else small(c, first[todo], size[todo])
        for x, n in zip(first[todo].tolist(), size[todo].tolist()):
            if long_gaps or n > SMALL_GROUP:
                yield from group({k: v[x : x + n] for k, v in c.items()})
            elif x in scored:
                yield from group({k: v[x : x + n] for k, v in c.items()}, scored[x])

    def small(c, first, size):
        """Best scores, and anchors before, of the small groups that have a chain good enough, by where they begin."""
        out, begin = {}, 0
        for upto in (2, 3, 4, 6, 8, 12, 16, 24, 32, 48, SMALL_GROUP):
            rows = np.flatnonzero((size > begin) & (size <= upto))
            begin = upto
            for i in range(0, len(rows), max(1, PAIRS_AT_ONCE // upto)):
                at, n = first[rows[i : i + PAIRS_AT_ONCE // upto]], size[rows[i : i + PAIRS_AT_ONCE // upto]]
                place = at[:, None] + np.minimum(np.arange(upto), n[:, None] - 1)
                q, t, span = (c[k][place] for k in ("qpos", "tpos", "span"))
                seg = c["seg"][place] if "seg" in c else np.zeros(q.shape, np.int64)
                o = options
                if limits is not None:
                    lengths, back = np.unique(c["length"][at] if "length" in c else np.zeros(len(at), np.int64), return_inverse=True)
                    x, y = np.array([limited(int(v)) for v in lengths]).T[:, back, None]
                    o = replace(options, max_dist_x=x, max_dist_y=y)
                f, before = best_scores_of_groups(q, t, span, seg, o)
                good = (np.where(np.arange(upto) < n[:, None], f, -np.inf) >= options.min_score).any(1)
                for g in np.flatnonzero(good).tolist():
                    out[int(at[g])] = f[g, : n[g]], before[g, : n[g]]
        return out

    def run(batches):
        held: list[dict[str, np.ndarray]] = []

        def out(rows):
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema)

        for batch in batches:
            c = {k: batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i, k in enumerate(columns)}
            if not batch.num_rows:
                continue
            key = np.stack([c[k] for k in ("qid", "tid", "rev")])
            last = key[:, -1:]
            open_ = int(np.flatnonzero((key != last).any(0)).max(initial=-1)) + 1  # where the last group begins
            if held and (open_ or any((held[-1][k][-1] != last[i, 0]) for i, k in enumerate(("qid", "tid", "rev")))):
                c = {k: np.concatenate([*(h[k] for h in held), c[k]]) for k in columns}
                open_ += sum(len(h["qid"]) for h in held)
                held = []
            if open_:
                yield out(list(some(c, 0, open_)))
                c = {k: v[open_:] for k, v in c.items()}
            held.append(c)
        if held:
            c = {k: np.concatenate([h[k] for h in held]) for k in columns}
            yield out(list(some(c, 0, len(c["qid"]))))

    # a number, as adaptive execution would put the few bytes of much work into a few tasks
    dealt = anchors.select(*columns).repartition(tasks(anchors.sparkSession), "qid", "tid", "rev").sortWithinPartitions("qid", "tid", "rev", "tpos", "qpos")
    found = map_arrow(dealt, run, CHAIN).repartition(tasks(anchors.sparkSession), "qid")
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "tid", "rev", F.element_at("places", 1).tpos)
    return found.withColumn("chain", F.row_number().over(w).cast("long") - 1)


def chains(anchors: DataFrame, options: ChainOptions = ChainOptions(), long_gaps: bool = False) -> DataFrame:
    """(qid, tid, rev, tpos, qpos, span, chain, score): chained anchors only."""
    rows = chain_rows(anchors, options, long_gaps)
    return rows.select("qid", "tid", "rev", F.explode("places").alias("x"), "chain", "score").select("qid", "tid", "rev", "x.tpos", "x.qpos", "x.span", "chain", "score")


def parents(regions: DataFrame, mask_level: float = 0.5, mask_len: int = 2**31 - 1, sub_diff: int = 6, alt_drop: float = 0.15) -> DataFrame:
    """Primary or secondary by overlap on the query: (qid, rank, qs, qe, score, cnt) -> with parent, subsc, n_sub, dp_max2.

    Hits come by rank. One that overlaps an earlier primary enough, for what it covers alone, is its
    secondary; it may raise the primary's second-best score and its number of near-equal rivals: those
    with as many anchors and, of aligned hits (a column dp_max, and tid, rs and re) elsewhere, those
    that align nearly as well. A rival on an alternate contig (``is_alt``) counts for less against one that is not.
    What rows bring along as ``subsc`` is only ever raised, and the first row's ``n_sub`` is counted on: rivals that were met among
    the chains and are gone since still make a hit less sure.
    """
    ship(regions.sparkSession)
    aligned = "dp_max" in regions.columns
    carried = [c for c in ("subsc", "n_sub") if c in regions.columns]
    regions = regions.drop("parent", "dp_max2")
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in regions.schema.fields]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank").reset_index(drop=True)
        qs, qe, sc, cnt, rank = (pdf[c].tolist() for c in ("qs", "qe", "score", "cnt", "rank"))
        dp = pdf["dp_max"].tolist() if aligned else None
        places = list(zip(pdf["tid"], pdf["rs"], pdf["re"])) if aligned else None
        primaries, parent, subsc, n_sub, second = [], [0] * len(pdf), [0] * len(pdf), [0] * len(pdf), [0] * len(pdf)
        if "subsc" in carried:
            subsc = pdf["subsc"].fillna(0).astype("int64").tolist()
        if "n_sub" in carried and len(pdf):
            n_sub[0] = int(pdf["n_sub"][0] or 0)
        alt = pdf["is_alt"].fillna(False).astype(bool).tolist() if "is_alt" in pdf else [False] * len(pdf)

        def less(score, i, p):
            return max(1, int(score * (1.0 - alt_drop) + 0.499)) if alt[i] and not alt[p] and score >= 0 else score

        for i in range(len(pdf)):
            over = [p for p in primaries if min(qe[i], qe[p]) > max(qs[i], qs[p])]
            covered, reach = 0, qs[i]
            for a, b in sorted((max(qs[i], qs[p]), min(qe[i], qe[p])) for p in over):
                covered += max(0, b - max(a, reach))
                reach = max(reach, b)
            alone = qe[i] - qs[i] - covered
            for p in over:
                common = min(qe[i], qe[p]) - max(qs[i], qs[p])
                short, long_ = sorted((qe[i] - qs[i], qe[p] - qs[p]))
                if common / short - alone / long_ > mask_level and alone <= mask_len:
                    parent[i] = rank[p]
                    subsc[p] = max(subsc[p], less(sc[i], i, p))
                    rival = cnt[i] >= cnt[p]
                    if aligned and (places[i] != places[p] or common != short):
                        second[p] = max(second[p], less(dp[i], i, p))
                        rival = rival or dp[p] - dp[i] <= sub_diff
                    n_sub[p] += int(rival)
                    break
            else:
                parent[i] = rank[i]
                primaries.append(i)
        return pdf.assign(parent=parent, subsc=subsc, n_sub=n_sub, dp_max2=second)

    new = [f"{c} long" for c in ("parent", "subsc", "n_sub", "dp_max2") if c not in carried]
    return regions.groupBy("qid").applyInPandas(run, ", ".join([*fields, *new]))
