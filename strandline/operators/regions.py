"""Mapping records: summaries of chains, ranks, secondaries, mapping quality, pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def summarise_chains(chain_anchors: DataFrame) -> DataFrame:
    """(qid, tid, rev, chain, tpos, qpos, span) -> one row per chain with its extent, matches and block length.

    Matched bases count an anchor's span, or what it adds to the previous one where they overlap; the
    block length counts the longer of the two gaps.
    """
    key = ["qid", "tid", "rev", "chain"]
    w = Window.partitionBy(*key).orderBy("tpos", "qpos")
    dt, dq = F.col("tpos") - F.lag("tpos").over(w), F.col("qpos") - F.lag("qpos").over(w)
    a = chain_anchors.withColumn("_dt", dt).withColumn("_dq", dq)
    first = F.col("_dt").isNull()
    small, large = F.least("_dt", "_dq"), F.greatest("_dt", "_dq")
    mlen = F.when(first | (small > F.col("span")), F.col("span")).otherwise(small)
    blen = F.when(first, F.col("span")).otherwise(large)
    return a.groupBy(*key).agg(
        F.count("*").alias("cnt"), F.min(F.col("qpos") - F.col("span") + 1).alias("qs"), F.max(F.col("qpos") + 1).alias("qe"),
        F.min(F.col("tpos") - F.col("span") + 1).alias("rs"), F.max(F.col("tpos") + 1).alias("re"), F.sum(mlen).alias("mlen"), F.sum(blen).alias("blen"))


def ranked(regions: DataFrame) -> DataFrame:
    """``rank`` within the query, best score first; ties by hash, then by place."""
    w = Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("hash"), "tid", "rs", "rev")
    return regions.withColumn("rank", F.row_number().over(w).cast("long"))


def with_parent(regions: DataFrame, *columns: str) -> DataFrame:
    """With ``_p``: these columns of the row that each row's parent is. A window over the query's few rows, not a join."""
    rows = F.collect_list(F.struct("rank", *columns)).over(Window.partitionBy("qid"))
    return regions.withColumn("_p", rows).withColumn("_p", F.get(F.filter("_p", lambda x: x["rank"] == F.col("parent")), F.lit(0)))


def top_secondaries(regions: DataFrame, pri_ratio: float = 0.8, min_diff: int = 30, best_n: int = 5, rescue_score: int | None = None) -> DataFrame:
    """Primaries, and of each query's secondaries the first ``best_n`` that come near enough to their parent's score.

    A row is primary if it is its own parent (``parent`` = ``rank``). Where rows have their extent, a copy of its
    parent is no secondary. With ``rescue_score`` a row on the other strand than its parent's stays for that
    (``strand_retained``) if it scores more.
    """
    where = [c for c in ("tid", "qs", "qe", "rs", "re", "rev") if c in regions.columns]
    r = with_parent(regions, "score", *where).withColumn("primary", F.col("parent") == F.col("rank"))
    near = (F.col("score") >= F.col("_p.score") * pri_ratio) | (F.col("score") + min_diff >= F.col("_p.score"))
    same = F.lit(False)
    if len(where) == 6:
        same = F.lit(True)
        for c in ("tid", "qs", "qe", "rs", "re"):
            same = same & F.col(c).eqNullSafe(F.col(f"_p.{c}"))
    turned = F.lit(False)
    if rescue_score is not None:
        turned = ~near & (F.col("score") > rescue_score) & (F.col("rev") != F.col("_p.rev"))
        r = r.withColumn("strand_retained", ~F.col("primary") & F.coalesce(turned, F.lit(False)))
    inv = F.coalesce(F.col("inv"), F.lit(False)) if "inv" in regions.columns else F.lit(False)  # these stay in any case
    r = r.withColumn("_in", ~F.col("primary") & ~inv & F.coalesce(near & ~same | turned, F.lit(False)))
    n = F.row_number().over(Window.partitionBy("qid", "_in").orderBy("rank"))
    return r.withColumn("_n", n).filter(F.col("primary") | inv | F.col("_in") & (F.col("_n") <= best_n)).drop("_in", "_n", "_p")


def fragment_secondaries(regions: DataFrame, pri_ratio: float = 0.5, near_ratio: float = 0.2, one_ratio: float = 0.7, min_diff: int = 42, best_n: int = 20) -> DataFrame:
    """Of chains of read pairs the primaries and the first ``best_n`` secondaries that come near enough to their parent.

    Rows have ``first`` and ``second``, the mates' lengths, and ``frag_gap``, how far apart they may lie. A secondary beside its
    parent needs little of its score (it may hold the other mate); one elsewhere needs ``pri_ratio``, and more if it
    has one mate where its parent has both.
    """
    r = with_parent(regions, "score", "tid", "rev", "qs", "qe", "rs", "re").withColumn("primary", F.col("parent") == F.col("rank"))
    most = F.col("first") + F.col("second") + F.col("frag_gap")
    near = (F.col("tid") == F.col("_p.tid")) & (F.col("rev") == F.col("_p.rev")) & (F.col("re") - F.col("_p.rs") < most) & (F.col("_p.re") - F.col("rs") < most)
    both = lambda p: (F.col(f"{p}qs") < F.col("first")) & (F.col(f"{p}qe") > F.col("first"))
    ratio = F.when(near, near_ratio).when(both("") | (both("") == both("_p.")), pri_ratio).otherwise(one_ratio)
    enough = (F.col("score") + min_diff >= F.col("_p.score")) | (F.col("score") >= F.col("_p.score") * ratio)
    r = r.withColumn("_in", ~F.col("primary") & F.coalesce(enough, F.lit(False)))
    n = F.row_number().over(Window.partitionBy("qid", "_in").orderBy("rank"))
    return r.withColumn("_n", n).filter(F.col("primary") | F.col("_in") & (F.col("_n") <= best_n)).drop("_in", "_n", "_p")


def split_fragments(regions: DataFrame) -> DataFrame:
    """Chains of read pairs (with ``places``, ``first`` and ``second``) as chains of the mates that they touch.

    A mate's chain has the anchors that lie in it, in its own coordinates, and the score of the whole; qid becomes
    2 * qid + the mate's number.
    """
    total = F.col("first") + F.col("second")
    seg = F.explode(F.array(F.lit(0), F.lit(1))).alias("seg")
    r = regions.withColumn("seg", seg).withColumn("qlen", F.when(F.col("seg") == 0, F.col("first")).otherwise(F.col("second")))
    begin = F.when(F.col("seg") == 0, F.lit(0)).otherwise(F.col("first"))
    r = r.withColumn("_off", F.when(F.col("rev") == 1, total - F.col("qlen") - begin).otherwise(begin))
    inside = F.filter("places", lambda p: (p.qpos >= F.col("_off")) & (p.qpos < F.col("_off") + F.col("qlen")))
    r = r.withColumn("places", F.transform(inside, lambda p: F.struct(p.tpos.alias("tpos"), (p.qpos - F.col("_off")).alias("qpos"), p.span.alias("span"))))
    n = F.size("places")
    r = r.filter(n > 0).withColumn("qid", F.col("qid") * 2 + F.col("seg"))
    later = lambda f: F.aggregate(F.zip_with(F.slice("places", F.lit(1), n - 1), F.slice("places", F.lit(2), n - 1), f), F.lit(0).cast("long"), lambda a, b: a + b)
    head = F.element_at("places", 1).span
    r = r.withColumns({
        "cnt": n.cast("long"),
        "_a": F.array_min(F.transform("places", lambda p: p.qpos - p.span + 1)), "_b": F.array_max(F.transform("places", lambda p: p.qpos + 1)),
        "rs": F.array_min(F.transform("places", lambda p: p.tpos - p.span + 1)), "re": F.array_max(F.transform("places", lambda p: p.tpos + 1)),
        "mlen": head + later(lambda p, c: F.least(c.qpos - p.qpos, c.tpos - p.tpos, c.span)), "blen": head + later(lambda p, c: F.greatest(c.qpos - p.qpos, c.tpos - p.tpos))})
    return on_forward(r.drop("qs", "qe").withColumnsRenamed({"_a": "qs", "_b": "qe"})).drop("_off")


def on_forward(regions: DataFrame) -> DataFrame:
    """Extents on the strand that matched as extents on the forward query, or back; rows have ``qlen``."""
    turned = {a: F.when(F.col("rev") == 1, F.col("qlen") - F.col(b)).otherwise(F.col(a)) for a, b in (("qs", "qe"), ("qe", "qs"))}
    return regions.withColumns(turned)


def strand_filter(regions: DataFrame) -> DataFrame:
    """Rows kept for their strand stay if they diverge under five times their parent, or under one per cent."""
    ok = ~F.col("strand_retained") | (F.col("div") < F.col("_p.div") * 5) | (F.col("div") < 0.01)
    return with_parent(regions, "div").filter(ok).drop("_p")


def region_filter(regions: DataFrame, min_cnt: int = 3, min_mlen: int = 0, min_dp: int = 0, max_clip: float = 1.0) -> DataFrame:
    """Aligned rows with anchors, matches and score enough, that are not clipped by more than a share of the query at
    both ends. Inversions and parts of a chain that was split need not have the anchors."""
    few = F.col("cnt") < min_cnt
    for c in ("inv", "split"):
        if c in regions.columns:
            few = few & ~F.col(c)
    clipped = (F.col("qs") > F.col("qlen") * max_clip) & (F.col("qlen") - F.col("qe") > F.col("qlen") * max_clip) if "qlen" in regions.columns else F.lit(False)
    return regions.filter(~few & (F.col("mlen") >= min_mlen) & (F.col("dp_max") >= min_dp) & ~clipped)


def mark_alternates(regions: DataFrame, refs: DataFrame, drop: float = 0.15, by: str = "score") -> DataFrame:
    """Scores on alternate contigs count less when hits are ranked."""
    r = regions.join(refs.select(F.col("rid").alias("tid"), "is_alt"), "tid", "left")
    return r.withColumn("rank_score", F.when(F.col("is_alt") & (F.col(by) >= 0), F.greatest(F.lit(1), F.floor(F.col(by) * (1 - drop) + 0.499))).otherwise(F.col(by)))


def renumbered(regions: DataFrame) -> DataFrame:
    """Ranks without holes after a filter, parents with them; rows whose parent went are their own."""
    w = Window.partitionBy("qid").orderBy("rank")
    r = with_parent(regions.withColumn("new", F.row_number().over(w).cast("long")), "new")
    return r.withColumn("parent", F.coalesce(F.col("_p.new"), F.col("new"))).withColumn("rank", F.col("new")).drop("new", "_p")


def sam_primary(regions: DataFrame) -> DataFrame:
    """The first primary of each query is the one that stands for it in SAM."""
    w = Window.partitionBy("qid", F.col("parent") == F.col("rank")).orderBy("rank")
    return regions.withColumn("sam_pri", (F.col("parent") == F.col("rank")) & (F.row_number().over(w) == 1))


def mapq(regions: DataFrame, min_chain_score: int = 40) -> DataFrame:
    """Mapping quality of rows without an alignment: (qid, score, score0, cnt, subsc, n_sub, rep_len, primary)."""
    total = F.sum(F.when(F.col("primary"), F.col("score")).otherwise(0)).over(Window.partitionBy("qid"))
    uniq = total / (total + F.col("rep_len"))
    by_score = F.when(F.col("score") > 100, F.lit(1.0)).otherwise(F.col("score") * 0.01) * uniq
    by_count = F.when(F.col("cnt") > 10, F.lit(1.0)).otherwise(F.col("cnt") * 0.1)
    subsc = F.greatest(F.col("subsc"), F.lit(min_chain_score))
    x = 40.0 * F.least(by_score, by_count) * (1.0 - subsc / F.col("score0")) * F.log(F.col("score").cast("double"))
    q = F.floor(x) - F.floor(4.343 * F.log(F.col("n_sub") + 1.0) + 0.499)
    return regions.withColumn("mapq", F.when(F.col("primary"), F.greatest(F.lit(0), F.least(F.lit(60), q))).otherwise(0).cast("int"))


def mapq_aligned(regions: DataFrame, min_chain_score: int = 40, match: int = 2, short_reads: bool = False, spliced: bool = False) -> DataFrame:
    """Mapping quality of aligned rows: ``mapq``'s columns, and mlen, blen, dp_max, dp_max2, inv.

    The share of matches scales it, and the second-best alignment and the second-best chain lower it
    together; of long reads it is no more than the difference of the two alignments allows. A primary
    that aligns better than any rival has 1 at least; inversions have what their neighbours have. Of short spliced reads
    chains tell little, so alignments alone count, and the only placement over an intron has 10 more.
    """
    total = F.sum(F.when(F.col("primary"), F.col("score")).otherwise(0)).over(Window.partitionBy("qid"))
    by_score = F.when(F.col("score") > 100, F.lit(1.0)).otherwise(F.col("score") * 0.01) * (total / (total + F.col("rep_len")))
    by_count = F.when(F.col("cnt") > 10, F.lit(1.0)).otherwise(F.col("cnt") * 0.1)
    subsc = F.greatest(F.col("subsc"), F.lit(min_chain_score))
    identity = F.col("mlen") / F.col("blen")
    scale = 40.0 * identity * F.least(by_score, by_count) * F.log(F.col("dp_max") / F.lit(float(match)))
    chains = subsc / F.col("score0")
    both = F.col("dp_max2") / F.col("dp_max") * (F.lit(1.0) if short_reads and spliced else chains)
    x = F.floor(scale * (1.0 - both * both))
    if not short_reads:
        x = F.least(x, F.floor(6.02 * identity * identity * (F.col("dp_max") - F.col("dp_max2")) / float(match) + 0.499))
    if short_reads and spliced:
        over = F.coalesce(F.col("cigar").contains("N"), F.lit(False))
        rivals = F.sum((~F.col("primary") & over).cast("int")).over(Window.partitionBy("qid"))
        x = x + F.when(over & (rivals == 0), 10).otherwise(0)
    q = F.when((F.col("dp_max2") > 0) & (F.col("dp_max") > 0), x).otherwise(F.floor(scale * (1.0 - chains))) - F.floor(4.343 * F.log(F.col("n_sub") + 1.0) + 0.499)
    q = F.greatest(F.lit(0), F.least(F.lit(60), q))
    q = F.when((q == 0) & (F.col("dp_max") > F.col("dp_max2")), 1).otherwise(q)
    return inversion_mapq(regions.withColumn("mapq", F.when(F.col("primary") & ~F.col("inv"), q).otherwise(0).cast("int")))


def inversion_mapq(regions: DataFrame) -> DataFrame:
    """An inversion that is a primary has the lesser quality of the primaries before and behind it on the target; without both, its own."""
    w = Window.partitionBy("qid", "primary").orderBy(*[c for c in ("tid", "rs", "rank") if c in regions.columns])
    before, behind = F.lag("mapq").over(w), F.lead("mapq").over(w)
    there = F.col("inv") & F.col("primary") & before.isNotNull() & behind.isNotNull()
    return regions.withColumn("mapq", F.when(there, F.least(before, behind)).otherwise(F.col("mapq")))


def divergence(n_match: Column, n_tot: Column, k: Column) -> Column:
    """Of two sequences, from how many of the seeds between a chain's ends it holds."""
    return F.when(n_tot > 0, 1 - F.pow(n_match / n_tot, 1 / k)).otherwise(F.lit(1.0))


def chain_divergence(chain_anchors: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """(qid, tid, rev, chain, n_match, n_tot, div): the seeds of the query between a chain's first and last one."""
    key = ["qid", "tid", "rev", "chain"]
    ends = chain_anchors.groupBy(*key).agg(F.countDistinct("qpos").alias("n_match"), F.min("qpos").alias("a"), F.max("qpos").alias("b"))
    s = seeds.select(F.col("seq_id").alias("qid"), "pos")
    inside = ends.join(s, "qid").filter((F.col("pos") >= F.col("a")) & (F.col("pos") <= F.col("b")))
    n = inside.groupBy(*key, "n_match").agg(F.count("*").alias("n_tot"))
    return n.select(*key, "n_match", "n_tot", F.round(divergence(F.col("n_match"), F.col("n_tot"), F.lit(float(k))), 6).alias("div"))


def pairs(first: DataFrame, second: DataFrame, max_gap: int) -> DataFrame:
    """Best pair of mates on one contig and strand within a distance, by the sum of scores, then hashes.

    Mates are joined by query, contig and strand; places further apart than the gap fail the condition.
    """
    a = first.select("qid", "tid", "rev", *[F.col(c).alias(f"{c}1") for c in ("rank", "rs", "re", "score", "hash")])
    b = second.select("qid", "tid", "rev", *[F.col(c).alias(f"{c}2") for c in ("rank", "rs", "re", "score", "hash")])
    gap = F.greatest("rs1", "rs2") - F.least("re1", "re2")
    p = a.join(b, ["qid", "tid", "rev"]).filter(gap <= max_gap)
    w = Window.partitionBy("qid").orderBy(F.desc(F.col("score1") + F.col("score2")), F.desc(F.col("hash1") + F.col("hash2")), "tid", "rank1", "rank2")
    return p.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("qid", "tid", "rev", "rank1", "rank2", (F.col("score1") + F.col("score2")).alias("score"))


def pair_up(hits: DataFrame, max_gap: int, bonus: int = 33, sub_diff: int = 6, match: int = 2) -> DataFrame:
    """Hits of read pairs: (frag, seg, rank, parent, tid, rev, rs, re, dp_max, hash, mapq, primary, sam_pri) -> with ``proper``.

    Mates face each other on one contig, the left one not more than ``max_gap`` (or a column ``frag_gap``) before the right one. Of pairs
    that align nearly as well as both best ends could, the best one is proper: its hits become primary, and
    their quality rises towards the pair's, which rival pairs lower.
    """
    side = F.col("rev").bitwiseXOR(F.col("seg"))
    best_ends = hits.groupBy("frag", "seg").agg(F.max("dp_max").alias("m")).groupBy("frag").agg(F.sum("m").alias("most"), F.count("*").alias("ends")).filter("ends = 2")
    h = hits.join(best_ends, "frag").withColumn("_o", side)
    part = lambda right: h.filter((F.col("seg") == F.col("_o")) != F.lit(right)).select("frag", "tid", "_o", "most", *[c for c in ("frag_gap",) if c in hits.columns], *[F.col(c).alias(f"{c}_{int(right)}") for c in ("seg", "rank", "rs", "re", "dp_max", "hash", "mapq")])
    p = part(False).join(part(True).drop("most", "frag_gap"), ["frag", "tid", "_o"]).filter((F.col("rs_1") >= F.col("rs_0")) & (F.col("rs_1") - F.col("re_0") <= (F.col("frag_gap") if "frag_gap" in hits.columns else max_gap)))
    p = p.withColumn("s", F.col("dp_max_0") + F.col("dp_max_1")).filter(F.col("s") >= F.greatest(F.lit(0), F.col("most") - bonus))
    w = Window.partitionBy("frag").orderBy(F.desc("s"), F.desc(F.col("hash_0") + F.col("hash_1")), "tid", "rank_0", "rank_1")
    every = Window.partitionBy("frag")
    p = p.withColumns({"_r": F.row_number().over(w), "_next": F.lead("s").over(w), "_n": F.count("*").over(every), "_max": F.max("s").over(every)})
    p = p.withColumn("_sub", F.sum((F.col("s") + sub_diff >= F.col("_max")).cast("int")).over(every)).filter("_r = 1")
    q = F.greatest("mapq_0", "mapq_1")
    q = F.when(F.col("_n") > 1, F.least(q, F.floor(6.02 * (F.col("s") - F.col("_next")) / float(match) - 4.343 * F.log(F.col("_sub").cast("double"))))).otherwise(q)
    ends = F.explode(F.array(*[F.struct(F.col(f"seg_{k}").alias("seg"), F.col(f"rank_{k}").alias("_best")) for k in (0, 1)]))
    floor = F.when(F.col("_n") == 1, 2).when(F.col("s") > F.col("_next"), 1).otherwise(0)
    p = p.select("frag", q.alias("_q"), floor.alias("_floor"), ends.alias("e")).select("frag", "_q", "_floor", "e.seg", "e._best")
    h = hits.join(p, ["frag", "seg"], "left")
    old = h.filter("rank = _best").select("frag", "seg", F.col("parent").alias("_old"), F.col("sam_pri").alias("_was"))
    h = h.join(old, ["frag", "seg"], "left")
    mine = F.coalesce(F.col("rank") == F.col("_best"), F.lit(False))
    lifted = F.coalesce((F.col("_old") != F.col("_best")) & (F.col("parent") == F.col("_old")), F.lit(False))
    quality = F.when(mine, F.greatest(pair_mapq(F.col("mapq"), F.greatest("_q", F.lit(0))), F.col("_floor"))).when(lifted & (F.col("rank") == F.col("_old")), 0).otherwise(F.col("mapq")).cast("int")
    h = h.withColumn("mapq", quality).withColumn("proper", mine).withColumn("sam_pri", F.when(F.col("_was") == F.lit(False), mine).otherwise(F.col("sam_pri")))
    h = h.withColumn("parent", F.when(lifted, F.col("_best")).otherwise(F.col("parent"))).withColumn("primary", F.col("parent") == F.col("rank"))
    return h.drop("_q", "_floor", "_best", "_old", "_was")


def pair_mapq(own: Column, pair: Column) -> Column:
    """A read's quality, lifted towards that of its pair."""
    return F.when(own < pair, F.floor(0.2 * own + 0.8 * pair + 0.499)).otherwise(own).cast("int")


def split_at(chain_anchors: DataFrame, cuts: DataFrame) -> DataFrame:
    """Chains cut before given anchors: (qid, chain, at) says from which anchor, in order, a part begins.

    Parts are numbered within the chain; a chain without cuts is one part.
    """
    w = Window.partitionBy("qid", "chain").orderBy("tpos", "qpos")
    a = chain_anchors.withColumn("_i", F.row_number().over(w) - 1)
    c = cuts.select("qid", "chain", F.col("at").alias("_i"), F.lit(1).alias("_cut"))
    a = a.join(c, ["qid", "chain", "_i"], "left")
    return a.withColumn("part", F.sum(F.coalesce("_cut", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_i", "_cut")


def merged_parts(parts: list[DataFrame], id_shifts: list[int]) -> DataFrame:
    """Hits of an index in several parts as hits of the whole: target ids shifted, ranks made anew."""
    out = None
    for p, shift in zip(parts, id_shifts):
        p = p.withColumn("tid", F.col("tid") + shift)
        out = p if out is None else out.unionByName(p)
    return ranked(out)
