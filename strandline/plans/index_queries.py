"""Queries that build an index, look queries up in it and make anchors and regions of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import index, mating, regions, seeding, sketch
from . import oracle as O
from .sketch_queries import sequences, table

K, W = 15, 11


def targets(s, d):
    return sketch.seeds(sequences(s, d), K, W)


def query_seeds(s, d):
    return sketch.seeds(sequences(s, d, "benchmark", "item_id"), K, W)


def query_lengths(s, d):
    return sequences(s, d, "benchmark", "item_id").select("seq_id", F.length("seq").cast("long").alias("length"))


def _index(s, d):
    i = index.build(targets(s, d))
    one = F.element_at("occ", 1)
    return i.select("key", "n", one.rid.alias("first_rid"), one.pos.alias("first_pos"), F.aggregate("occ", F.lit(0).cast("long"), lambda a, o: (a * 31 + o.rid * 7 + o.pos + o.strand) % 1000003).alias("occ_digest"))


def _stats(s, d):
    total = sequences(s, d).agg(F.sum(F.length("seq")).alias("total_length"))
    return index.stats(index.key_counts(targets(s, d)), total)


def _cutoff(s, d):
    c = index.key_counts(targets(s, d))
    cuts = [index.max_occ(c, f).select(F.lit(f).alias("fraction"), "max_occ") for f in (0.5, 0.02, 0.0002)]
    return cuts[0].union(cuts[1]).union(cuts[2]).crossJoin(index.mid_occ(c))


def _lookup(s, d):
    # a cut-off before the join; the occurrences themselves stay in their arrays
    hit = index.lookup(query_seeds(s, d), index.key_counts(targets(s, d)))
    return hit.groupBy("seq_id").agg(F.count("*").alias("seeds_found"), F.sum("n").alias("hits"), F.max("n").alias("most"))


def _anchors(s, d):
    t = targets(s, d)
    return seeding.anchors(query_seeds(s, d), t, query_lengths(s, d), index.mid_occ(index.key_counts(t)))


def _names(s, d, name, id_col):
    return sequences(s, d, name, id_col).select(F.col("seq_id").alias("rid"), F.concat(F.lit("s"), (F.col("seq_id") % 100).cast("string")).alias("name"), F.length("seq").cast("long").alias("length"))


def _no_dual(s, d):
    """Items and documents under names that the two tables share."""
    a = seeding.with_names(_anchors(s, d), _names(s, d, "benchmark", "item_id"), _names(s, d, "documents", "doc_id"))
    return _summed(seeding.no_dual(seeding.no_diagonal(a)))


def _summed(a):
    return a.groupBy("qid", "tid", "rev").agg(F.count("*").alias("n"), F.min("qpos").alias("q0"), F.max("qpos").alias("q1"), F.min("tpos").alias("t0"), F.max("tpos").alias("t1"))


def _pseudo_regions(s, d):
    """One row per query, target and strand with two anchors at least."""
    return _regions(_anchors(s, d))


def _regions(anchors):
    return _scored(regions.summarise_chains(anchors.withColumn("chain", F.lit(0))).filter("cnt >= 2"))


def _scored(r):
    h = (F.col("tid") * 7919 + F.col("rs") * 31 + F.col("rev")) % 1000003
    return r.withColumn("score", F.col("mlen")).withColumn("hash", h)


def _tandem(s, d):
    return seeding.tandem(targets(s, d)).filter("tandem").select("seq_id", "pos", "key")


def _qocc(s, d):
    return seeding.query_frequency_filter(targets(s, d), 2, 0.005).groupBy("seq_id").agg(F.count("*").alias("kept"), F.sum("pos").alias("pos_sum"))


def _with_counts(s, d):
    q = sketch.seeds(sequences(s, d), K, W)
    return q.join(index.key_counts(q), "key").select("seq_id", "pos", "span", "n")


def _streaks(s, d):
    n = sequences(s, d).select("seq_id", F.length("seq").cast("long").alias("length"))
    return seeding.select_streaks(_with_counts(s, d), n, 2, 400, 50).select("seq_id", "pos", "n", "kept")


def _rep_len(s, d):
    return seeding.repetitive_length(_with_counts(s, d).filter("n > 2"))


def _topn(s, d):
    r = regions.ranked(_pseudo_regions(s, d))
    r = r.withColumn("parent", F.lit(1)).select("qid", "tid", "rev", "rs", "score", "rank", "parent")
    return regions.top_secondaries(r, 0.8, 2, 5).select("qid", "tid", "rev", "rs", "score", "rank", "primary")


def _mapq(s, d):
    r = regions.ranked(_pseudo_regions(s, d))
    best2 = r.groupBy("qid").agg(F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("score"))), F.lit(0)).alias("subsc"), (F.count("*") - 1).alias("n_sub"))
    r = r.join(best2, "qid").withColumn("primary", F.col("rank") == 1).withColumn("score0", F.col("score")).withColumn("rep_len", F.lit(0))
    return regions.mapq(r, 20).select("qid", "tid", "rev", "rank", "mapq")


def _divergence(s, d):
    a = _anchors(s, d).withColumn("chain", F.lit(0)).filter("rev = 0")
    return regions.chain_divergence(a, query_seeds(s, d), K).select("qid", "tid", "n_match", "n_tot", "div")


def _pairs(s, d):
    """Halves of all documents as pairs on all documents."""
    return mating.pair_halves(sequences(s, d), K, W, 5000)


def _collisions(s, d):
    return index.collisions(sketch.sampled_kmers(sequences(s, d), K, W), K)


def _turns(s, d):
    t = table(s, d, "conversations").select(F.col("conv_id").alias("frag_id"), F.col("turn").alias("seg"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("length"))
    return t


def _fragment_split(s, d):
    from ..functions.seq import bases

    t = table(s, d, "conversations").select(F.col("conv_id").alias("frag_id"), F.col("turn").alias("seg"), bases("text").alias("seq"))
    off = seeding.fragment_offsets(t.select("frag_id", "seg", F.length("seq").cast("long").alias("length")))
    m = sketch.minimizers(t.select(F.struct("frag_id", "seg").alias("seq_id"), "seq"), 10, 5).select("seq_id.frag_id", "seq_id.seg", "pos")
    whole = m.join(off, ["frag_id", "seg"]).select(F.col("frag_id").alias("qid"), F.lit(0).alias("tid"), F.lit(0).alias("rev"), F.lit(0).alias("tpos"), (F.col("pos") + F.col("offset")).alias("qpos"), F.lit(10).alias("span"))
    return seeding.split_by_segment(whole, off).groupBy("qid", "seg").agg(F.count("*").alias("n"), F.sum("qpos").alias("pos_sum"))


QUERIES = {
    "index_build": _index,
    "index_stats": _stats,
    "index_cutoff": _cutoff,
    "index_lookup": _lookup,
    "key_collision_audit": _collisions,
    "seeds_tandem": _tandem,
    "seeds_qocc_filter": _qocc,
    "seeds_streak_select": _streaks,
    "seed_rep_len": _rep_len,
    "anchors": lambda s, d: _summed(_anchors(s, d)),
    "anchors_no_dual": _no_dual,
    "anchors_reverse": lambda s, d: _summed(seeding.strand_only(_anchors(s, d), True)),
    "chain_regions": lambda s, d: _pseudo_regions(s, d).select("qid", "tid", "rev", "cnt", "qs", "qe", "rs", "re", "mlen", "blen"),
    "regions_topn": _topn,
    "mapq_nocigar": _mapq,
    "divergence": _divergence,
    "pairing": _pairs,
    "fragment_offsets": lambda s, d: seeding.fragment_offsets(_turns(s, d)).select("frag_id", "seg", "length", "offset"),
    "fragment_split": _fragment_split,
}

_B, _I = O.seqs(), O.seqs("i", "benchmark", "item_id")
_T = f"{_B}, {O.seeds('t', 'b', K, W)}"
_C = f"{_T}, cnt AS (SELECT key, count(*) AS n FROM t GROUP BY key)"
_H = "i AS (SELECT seq_id*2 AS seq_id, substr(seq, 1, length(seq)//2) AS seq FROM b UNION ALL SELECT seq_id*2 + 1, substr(seq, length(seq)//2 + 1) FROM b)"
_CAP = ("ranked AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS k, count(*) OVER () AS c FROM cnt), cap AS (SELECT coalesce(max(greatest(10, least(1000000, n + 1))), 1000000) AS mid_occ FROM ranked WHERE k = CAST(floor((1 - 0.0002::DOUBLE)*c) AS BIGINT))")
_A = (f"{_C}, {_CAP}, {_I}, {O.seeds('q', 'i', K, W)}, a AS (SELECT q.seq_id AS qid, t.seq_id AS tid, CAST(q.strand <> t.strand AS INT) AS rev, t.pos AS tpos, "
      f"CASE WHEN q.strand = t.strand THEN q.pos ELSE length(i.seq) - (q.pos + 1 - q.span) - 1 END AS qpos, q.span FROM q JOIN i ON q.seq_id = i.seq_id JOIN t ON q.key = t.key JOIN cnt ON cnt.key = t.key WHERE cnt.n <= (SELECT mid_occ FROM cap))")
_SUM = "SELECT qid, tid, rev, count(*) AS n, min(qpos) AS q0, max(qpos) AS q1, min(tpos) AS t0, max(tpos) AS t1 FROM a {where} GROUP BY qid, tid, rev"
_R = (_A + ", g AS (SELECT *, tpos - lag(tpos) OVER w AS dt, qpos - lag(qpos) OVER w AS dq FROM a WINDOW w AS (PARTITION BY qid, tid, rev ORDER BY tpos, qpos)), "
      "r0 AS (SELECT qid, tid, rev, count(*) AS cnt, min(qpos - span + 1) AS qs, max(qpos + 1) AS qe, min(tpos - span + 1) AS rs, max(tpos + 1) AS re, "
      "CAST(sum(CASE WHEN dt IS NULL OR least(dt, dq) > span THEN span ELSE least(dt, dq) END) AS BIGINT) AS mlen, CAST(sum(CASE WHEN dt IS NULL THEN span ELSE greatest(dt, dq) END) AS BIGINT) AS blen FROM g GROUP BY qid, tid, rev HAVING count(*) >= 2), "
      "r AS (SELECT *, (tid*7919 + rs*31 + rev) % 1000003 AS hash FROM r0), rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY mlen DESC, hash DESC, tid, rs, rev) AS rank FROM r)")
_S = f"{_C}, sc AS (SELECT t.seq_id, t.pos, t.span, cnt.n FROM t JOIN cnt USING (key))"

_P = _R.replace(_I, _H)

ORACLES = {
    "index_build": f"WITH {_T}, o AS (SELECT key, list({{'rid': seq_id, 'pos': pos, 'strand': strand}} ORDER BY seq_id, pos, strand) AS occ FROM t GROUP BY key) "
    "SELECT key, len(occ) AS n, occ[1].rid AS first_rid, occ[1].pos AS first_pos, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(occ, lambda x: CAST(x.rid*7 + x.pos + x.strand AS BIGINT))), lambda u, v: (u*31 + v) % 1000003) AS occ_digest FROM o",
    "index_stats": f"WITH {_C}, x AS (SELECT count(*) AS distinct_keys, count(*) FILTER (n = 1) AS singletons, CAST(sum(n) AS BIGINT) AS t FROM cnt), l AS (SELECT CAST(sum(length(seq)) AS BIGINT) AS total_length FROM b) "
    "SELECT distinct_keys, singletons, round(100*singletons/distinct_keys, 4) AS singleton_pct, round(t/distinct_keys, 6) AS avg_occ, round(total_length/t, 6) AS avg_spacing, total_length FROM x, l",
    "index_cutoff": f"WITH {_C}, rk AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS k, count(*) OVER () AS c FROM cnt), f AS (SELECT unnest([0.5, 0.02, 0.0002]::DOUBLE[]) AS fraction), "
    "m AS (SELECT fraction, n + 1 AS max_occ FROM f JOIN rk ON k = CAST(floor((1 - fraction)*c) AS BIGINT)) SELECT fraction, max_occ, (SELECT greatest(10, least(1000000, max_occ)) FROM m WHERE fraction = 0.0002) AS mid_occ FROM m",
    "index_lookup": f"WITH {_C}, {_I}, {O.seeds('q', 'i', K, W)} SELECT q.seq_id, count(*) AS seeds_found, CAST(sum(n) AS BIGINT) AS hits, max(n) AS most FROM q JOIN cnt USING (key) GROUP BY q.seq_id",
    "key_collision_audit": f"WITH {_T} SELECT count(DISTINCT c) AS raw_keys, (SELECT count(DISTINCT key) FROM t) AS hash_keys, count(DISTINCT CAST(xor(y, y >> 33) % {1 << 2 * K}::UBIGINT AS UBIGINT)) AS mixed_keys, count(*) AS seeds "
    "FROM (SELECT c, CAST((CAST(xor(c, c >> 33) AS UHUGEINT)*18397679294719823053::UHUGEINT) % 18446744073709551616::UHUGEINT AS UBIGINT) AS y FROM t_c)",
    "seeds_tandem": f"WITH {_T}, l AS (SELECT *, lag(key) OVER w AS p, lead(key) OVER w AS x FROM t WINDOW w AS (PARTITION BY seq_id ORDER BY pos)) SELECT seq_id, pos, key FROM l WHERE key = p OR key = x",
    "seeds_qocc_filter": f"WITH {_T}, l AS (SELECT *, count(*) OVER (PARTITION BY seq_id, key) AS n, count(*) OVER (PARTITION BY seq_id) AS a FROM t) SELECT seq_id, count(*) AS kept, CAST(sum(pos) AS BIGINT) AS pos_sum FROM l WHERE NOT (n > 2 AND n > a*0.005) GROUP BY seq_id",
    "seeds_streak_select": f"WITH {_S}, h AS (SELECT sc.*, length(b.seq) AS len, n > 2 AS bad FROM sc JOIN b USING (seq_id)), "
    "h1 AS (SELECT *, sum(CAST(NOT bad AS INT)) OVER (PARTITION BY seq_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS streak, coalesce(max(CASE WHEN NOT bad THEN pos END) OVER (PARTITION BY seq_id ORDER BY pos ROWS UNBOUNDED PRECEDING), 0) AS ps, "
    "coalesce(min(CASE WHEN NOT bad THEN pos END) OVER (PARTITION BY seq_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), len) AS pe FROM h), "
    "h2 AS (SELECT *, row_number() OVER (PARTITION BY seq_id, streak, bad ORDER BY n, pos) AS rk, least(128, floor((pe - ps)/50.0 + 0.499)) AS k FROM h1) SELECT seq_id, pos, n, (NOT bad OR (rk <= k AND n <= 400)) AS kept FROM h2",
    "seed_rep_len": f"WITH {_S}, s AS (SELECT seq_id, pos - span + 1 AS st, pos + 1 AS en FROM sc WHERE n > 2), e AS (SELECT DISTINCT seq_id, unnest(range(st, en)) AS p FROM s) SELECT seq_id, count(*) AS rep_len FROM e GROUP BY seq_id",
    "anchors": f"WITH {_A} " + _SUM.format(where=""),
    "anchors_no_dual": f"WITH {_A} " + _SUM.format(where="JOIN i ON i.seq_id = a.qid JOIN b ON b.seq_id = a.tid WHERE NOT (qid % 100 = tid % 100 AND length(i.seq) = length(b.seq) AND rev = 0 AND qpos = tpos) AND 's' || (qid % 100) <= 's' || (tid % 100)"),
    "anchors_reverse": f"WITH {_A} " + _SUM.format(where="WHERE rev = 1"),
    "chain_regions": f"WITH {_R} SELECT qid, tid, rev, cnt, qs, qe, rs, re, mlen, blen FROM r",
    "regions_topn": f"WITH {_R}, p AS (SELECT rk.*, first_value(mlen) OVER (PARTITION BY qid ORDER BY rank) AS ps FROM rk), "
    "c AS (SELECT *, rank <> 1 AND (mlen >= ps*0.8 OR mlen + 2 >= ps) AS inn FROM p), n AS (SELECT *, row_number() OVER (PARTITION BY qid, inn ORDER BY rank) AS k FROM c) SELECT qid, tid, rev, rs, mlen AS score, rank, rank = 1 AS primary FROM n WHERE rank = 1 OR (inn AND k <= 5)",
    "mapq_nocigar": f"WITH {_R}, s AS (SELECT qid, coalesce(max(CASE WHEN rank = 2 THEN mlen END), 0) AS subsc, count(*) - 1 AS n_sub FROM rk GROUP BY qid), "
    "x AS (SELECT rk.*, n_sub, least(CASE WHEN mlen > 100 THEN 1.0::DOUBLE ELSE mlen*0.01::DOUBLE END, CASE WHEN cnt > 10 THEN 1.0::DOUBLE ELSE cnt*0.1::DOUBLE END) AS pen, greatest(subsc, 20) AS sub FROM rk JOIN s USING (qid)) "
    "SELECT qid, tid, rev, rank, CAST(CASE WHEN rank = 1 THEN greatest(0, least(60, floor(40.0::DOUBLE*pen*(1.0::DOUBLE - sub/mlen)*ln(mlen::DOUBLE)) - floor(4.343::DOUBLE*ln(n_sub + 1.0::DOUBLE) + 0.499::DOUBLE))) ELSE 0 END AS INT) AS mapq FROM x",
    "divergence": f"WITH {_A}, e AS (SELECT qid, tid, count(DISTINCT qpos) AS n_match, min(qpos) AS x, max(qpos) AS y FROM a WHERE rev = 0 GROUP BY qid, tid), "
    f"n AS (SELECT e.qid, e.tid, n_match, count(*) AS n_tot FROM e JOIN q ON q.seq_id = e.qid AND q.pos BETWEEN x AND y GROUP BY e.qid, e.tid, n_match) SELECT qid, tid, n_match, n_tot, round(1 - pow(n_match/n_tot, 1/{K}.0::DOUBLE), 6) AS div FROM n",
    "pairing": f"WITH {_P}, p AS (SELECT x.qid//2 AS qid, x.tid, x.rev, x.rank AS rank1, y.rank AS rank2, x.mlen + y.mlen AS score, row_number() OVER (PARTITION BY x.qid//2 ORDER BY x.mlen + y.mlen DESC, x.hash + y.hash DESC, x.tid, x.rank, y.rank) AS k "
    "FROM rk x JOIN rk y ON x.qid % 2 = 0 AND y.qid = x.qid + 1 AND x.tid = y.tid AND x.rev = y.rev WHERE greatest(x.rs, y.rs) - least(x.re, y.re) <= 5000) SELECT qid, tid, rev, rank1, rank2, score FROM p WHERE k = 1",
    "fragment_offsets": "SELECT conv_id AS frag_id, turn AS seg, CAST(length(coalesce(text,'')) AS BIGINT) AS length, CAST(coalesce(sum(length(coalesce(text,''))) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset FROM conversations",
    "fragment_split": f"WITH b AS (SELECT {{'frag': conv_id, 'seg': turn}} AS seq_id, {O.BASES} AS seq FROM conversations), {O.minimizers('m', 'b', 10, 5)} SELECT seq_id.frag AS qid, seq_id.seg AS seg, count(*) AS n, CAST(sum(pos) AS BIGINT) AS pos_sum FROM m GROUP BY ALL",
}
