"""Sequences to mappings: sketch, index, look up, chain, rank, align, qualify."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.seq import reverse_complement
from ..operators import alignment as A
from ..operators import chaining, index, intervals, jumping, regions, seeding, sketch
from ..runtime import cut, scratch_path, ship, tasks
from .options import Options, preset


def seeds_of(refs_or_reads: DataFrame, o: Options, spread: bool = False) -> DataFrame:
    s = refs_or_reads.select(F.col("rid").alias("seq_id"), "seq")
    out = sketch.native_seeds(s, o.k, o.w, o.compressed, spread)
    if o.dust:
        out = sketch.unmasked(out, sketch.low_complexity(s, o.dust))
    return out


@dataclass(frozen=True)
class Index:
    """Seeds of references and how often each key occurs, both bucketed by key; the references (rid, name, seq, and is_alt where
    known), and the options that made them. Look-ups shuffle what is looked up, never the index."""
    seeds: DataFrame
    counts: DataFrame
    refs: DataFrame
    options: Options


@dataclass(frozen=True)
class Known:
    """What is known of introns before reads are mapped; all of it is used for spliced reads only.

    ``introns`` (chrom, st, en, strand) make their ends cheaper in alignments; ``scores`` (rid, strand, pos, type, score, see
    ``intervals.splice_scores``) take their place where given; over ``jumps`` (chrom, off, off2, flag, see ``intervals.jumps``)
    the ends of aligned reads are carried on.
    """
    introns: DataFrame | None = None
    scores: DataFrame | None = None
    jumps: DataFrame | None = None


def build_index(refs: DataFrame, options: Options | str | None = None) -> Index:
    o = options if isinstance(options, Options) else preset(options)
    path, spark = scratch_path(refs.sparkSession), refs.sparkSession
    refs = cut(refs)  # read again for names, lengths and windows
    index.save(seeds_of(refs, o, spread=True), f"{path}/seeds")
    seeds = index.load(spark, f"{path}/seeds")
    index.save(index.key_counts(seeds), f"{path}/counts")  # counted within the buckets
    return Index(seeds, index.load(spark, f"{path}/counts"), refs, o)


def save_index(x: Index, path: str) -> None:
    """Four tables: seeds and counts bucketed by key, references, and one row of options."""
    index.save(x.seeds, f"{path}/seeds")
    index.save(x.counts, f"{path}/counts")
    x.refs.write.mode("overwrite").parquet(f"{path}/refs")
    x.refs.sparkSession.createDataFrame([(json.dumps(asdict(x.options)),)], "options string").write.mode("overwrite").parquet(f"{path}/options")


def load_index(spark, path: str, options: Options | None = None) -> Index:
    """An index that was saved; options other than k, w and compression may be given anew."""
    made = Options(**json.loads(spark.read.parquet(f"{path}/options").first()[0]))
    o = options or made
    if (o.k, o.w, o.compressed) != (made.k, made.w, made.compressed):
        raise ValueError("the index was made with another k, w or compression")
    return Index(index.load(spark, f"{path}/seeds"), index.load(spark, f"{path}/counts"), spark.read.parquet(f"{path}/refs"), o)


def index_parts(refs: DataFrame, bases: int, options: Options | str | None = None) -> list[Index]:
    """References as indexes of about so many bases each, for a store that cannot hold one; ids stay those of the whole."""
    ids = refs.select("rid", F.length("seq").alias("n")).select("rid", F.floor(F.coalesce(F.sum("n").over(Window.orderBy("rid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) / bases).alias("part"))
    n = ids.agg(F.max("part")).first()[0]
    return [build_index(refs.join(ids.filter(F.col("part") == k).select("rid"), "rid", "left_semi"), options) for k in range((n if n is not None else -1) + 1)]


def cap_of(counts: DataFrame, o: Options) -> DataFrame:
    """One row: the largest number of occurrences of a key that is looked up."""
    if o.mid_occ > 0:
        return counts.sparkSession.range(1).select(F.lit(o.mid_occ).cast("long").alias("cap"))
    return index.mid_occ(counts, o.mid_occ_fraction, o.min_mid_occ, o.max_mid_occ).toDF("cap")


def _lengths(reads: DataFrame) -> DataFrame:
    """(seq_id, length) of what is chained as one: a read, or both mates of a fragment end to end."""
    n = F.length("seq").cast("long")
    if "frag_id" in reads.columns:
        return reads.groupBy(F.col("frag_id").alias("seq_id")).agg(F.sum(n).alias("length"))
    return reads.select(F.col("rid").alias("seq_id"), n.alias("length"))


def query_seeds(reads: DataFrame, x: Index, cap: DataFrame | None = None) -> DataFrame:
    """Seeds of reads that the index has: (key, seq_id, pos, span, strand, n, length, kept).

    ``kept`` are those that are not too frequent there, and of a streak of too frequent ones the rarest few. Reads with a
    ``frag_id`` are mates: their seeds are those of the fragment, places counted on from mate to mate, with ``seg``.
    """
    o = x.options
    cap = F.broadcast(cap if cap is not None else cap_of(x.counts, o))  # a single row
    q = seeds_of(reads, o)
    if "frag_id" in reads.columns:
        at = seeding.fragment_offsets(reads.select("frag_id", "seg", "rid", F.length("seq").cast("long").alias("length")))
        at = at.select(F.col("rid").alias("seq_id"), "frag_id", "seg", "offset")
        q = q.join(at, "seq_id").withColumn("pos", F.col("pos") + F.col("offset")).drop("seq_id", "offset").withColumnRenamed("frag_id", "seq_id")
    q = q.crossJoin(cap)
    if o.q_occ_fraction > 0:
        q = seeding.query_frequency_filter(q, F.col("cap"), o.q_occ_fraction)
    q = q.join(x.counts, "key")
    lengths = _lengths(reads)
    return seeding.select_streaks(q, lengths, F.col("cap"), o.max_max_occ, o.occ_dist).join(lengths, "seq_id")


def anchors_of(q: DataFrame, reads: DataFrame, x: Index) -> DataFrame:
    o = x.options
    kept = q.filter("kept")
    a = seeding.anchors(kept.select("key", "seq_id", "pos", "span", "strand", *[c for c in ("seg",) if c in q.columns]), x.seeds, kept.select("seq_id", "length").distinct())
    if o.no_diagonal or o.no_dual:
        named = lambda d: d.select("rid", "name", F.length("seq").cast("long").alias("length"))
        whole = reads.filter("seg = 0").withColumn("rid", F.col("frag_id")) if "frag_id" in reads.columns else reads
        a = seeding.with_names(a, named(whole), named(x.refs))
        a = seeding.no_diagonal(a) if o.no_diagonal else a
        a = seeding.no_dual(a) if o.no_dual else a
        a = a.drop("qname", "tname", "qlen", "tlen")
    if o.forward_only or o.reverse_only:
        a = seeding.strand_only(a, o.reverse_only)
    return a.join(_lengths(reads).withColumnRenamed("seq_id", "qid"), "qid")


def chains_of(a: DataFrame, o: Options) -> DataFrame:
    limits = None
    if o.short_reads:
        limits = lambda n: chaining.gap_limits(True, o.fragments, o.max_gap, o.max_gap_ref, o.max_frag_len, n)
    both = "seg" in a.columns
    wider = 0 if o.no_long_join or o.spliced or o.short_reads or both else o.bw_long
    options = replace(o.chaining(), segments=2) if both else o.chaining()
    return chaining.chain_rows(a, options, o.rmq, limits, wider)


def chained(reads: DataFrame, x: Index) -> tuple[DataFrame, DataFrame]:
    """(seeds, chains) of reads or fragments.

    Where ``max_occ`` allows more than the first look-up did, reads that lost seeds to it and have no chain, or whose best chain
    lacks a mate, are looked up and chained anew with it: the others are kept apart from them, so only these few pay.
    """
    o = x.options
    q = cut(query_seeds(reads, x))
    rows = chains_of(anchors_of(q, reads, x), o)
    if o.rmq or o.max_occ <= 0 or not (o.short_reads or o.spliced or o.no_long_join) or o.max_occ <= cap_of(x.counts, o).first()[0]:
        return q, rows
    rows = cut(rows)
    whole = rows.filter("chain = 0").select("qid", "rev", "places")
    if "frag_id" in reads.columns:  # both mates have anchors in the best chain
        ends = reads.groupBy(F.col("frag_id").alias("qid")).agg(F.max(F.when(F.col("seg") == 0, F.length("seq"))).alias("a"), F.coalesce(F.max(F.when(F.col("seg") == 1, F.length("seq"))), F.lit(0)).alias("b"))
        first = F.when(F.col("rev") == 1, F.col("b")).otherwise(F.col("a"))
        low, high = F.array_min(F.transform("places", lambda p: p.qpos)), F.array_max(F.transform("places", lambda p: p.qpos))
        whole = whole.join(ends, "qid").filter((F.col("b") == 0) | (low < first) & (high >= first))
    again = q.filter("not kept").select(F.col("seq_id").alias("qid")).distinct().join(whole.select("qid"), "qid", "left_anti")
    again = cut(again)
    by = "frag_id" if "frag_id" in reads.columns else "rid"
    few = reads.join(again.withColumnRenamed("qid", by), by, "left_semi")
    wide = reads.sparkSession.range(1).select(F.lit(o.max_occ).cast("long").alias("cap"))
    q2 = cut(query_seeds(few, x, wide))
    rows2 = chains_of(anchors_of(q2, few, x), o)
    rows = rows.join(again, "qid", "left_anti").unionByName(rows2)
    return q.join(again.withColumnRenamed("qid", "seq_id"), "seq_id", "left_anti").unionByName(q2), rows


def regions_of(rows: DataFrame, o: Options, alternates: DataFrame | None = None, select: bool = True) -> DataFrame:
    """Rows of ``chaining.chain_rows``, or aligned ones (with dp_max), ranked, with parents and, unless all are wanted, the
    secondaries that stay. All are made with secondaries: ``no_secondary`` is a matter of what is written (see ``written``)."""
    by = "dp_max" if "dp_max" in rows.columns else "score"
    r = rows.withColumn("hash", F.abs(F.xxhash64("qid", "tid", "rs", "rev")) % 2147483647)
    if alternates is not None:
        r = regions.mark_alternates(r.drop("is_alt", "rank_score"), alternates, o.alt_drop, by)
    else:
        r = r.withColumn("rank_score", F.col(by))
    w = Window.partitionBy("qid").orderBy(F.desc("rank_score"), F.desc("score"), F.desc("hash"), "tid", "rs", "rev")
    r = r.repartition(tasks(r.sparkSession), "qid")
    r = r.withColumn("rank", F.row_number().over(w).cast("long"))
    r = chaining.parents(r, o.mask_level, sub_diff=2 * o.match + o.mismatch, alt_drop=o.alt_drop)
    if not select or o.all_chains or o.pri_ratio <= 0:
        r = r.withColumn("primary", F.col("parent") == F.col("rank"))
        return r if "strand_retained" in r.columns else r.withColumn("strand_retained", F.lit(False))
    if "first" in r.columns:
        return regions.fragment_secondaries(r, o.pri_ratio, min_diff=2 * o.k, best_n=o.best_n).withColumn("strand_retained", F.lit(False))
    if by == "dp_max":  # chains that were kept for their strand are not kept for it again
        return regions.top_secondaries(r, o.pri_ratio, 2 * o.k, o.best_n)
    return regions.top_secondaries(r, o.pri_ratio, 2 * o.k, o.best_n, int(o.max_gap * 0.8))


#: Bases of a reference that are held together when windows of it are cut.
WINDOW_BLOCK = 1 << 18


def target_windows(regions_df: DataFrame, refs: DataFrame, block: int = WINDOW_BLOCK) -> DataFrame:
    """(row, tid, w0, w1) -> (row, target): the bases w0..w1 of each region's reference.

    References are cut into blocks, and a region meets the blocks its window lies in, so neither a row nor a
    task ever holds a whole chromosome for a short window of it.
    """
    n = F.length("seq")
    pieces = refs.select(F.col("rid").alias("tid"), "seq", F.explode(F.sequence(F.lit(0), F.floor(F.greatest(n - 1, F.lit(0)) / block).cast("int"))).alias("block"))
    pieces = pieces.select("tid", "block", F.substring("seq", F.col("block") * block + 1, F.lit(block)).alias("piece"))
    need = regions_df.select("row", "tid", "w0", "w1", F.explode(F.sequence(F.floor(F.col("w0") / block).cast("int"), F.floor(F.greatest(F.col("w1") - 1, F.col("w0")) / block).cast("int"))).alias("block"))
    low = F.col("block") * block
    cut = F.substring("piece", (F.greatest(F.col("w0") - low, F.lit(0)) + 1).cast("int"), (F.least(F.col("w1"), low + block) - F.greatest("w0", low)).cast("int"))
    got = need.join(pieces, ["tid", "block"]).select("row", "block", cut.alias("piece"))
    return got.groupBy("row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "piece"))), lambda p: p.piece), "").alias("target"))


ALIGNED = "qid long, qname string, qlen long, tid long, tname string, tlen long, rev int, cnt long, score long, score0 long, rep_len long, qs long, qe long, rs long, re long, mlen long, blen long, dp_score long, dp_max long, nm long, n_ambi long, div double, inv boolean, split boolean, strand_retained boolean, subsc long, n_sub long, trans string, cigar string, cs string, ds string, md string"


def known_in(windows: DataFrame, known: Known | None) -> DataFrame:
    """(row, tid, tname, w0, w1) -> (row, introns, scores): what is known within each window, places counted from its begin.

    Joined by bins of places; a row gets what lies in its window, which the read's reach bounds. Columns are null where nothing is.
    """
    none = windows.select("row", F.lit(None).cast("array<struct<st:long,en:long,strand:string>>").alias("introns"), F.lit(None).cast("array<struct<pos:long,strand:string,acceptor:boolean,score:int>>").alias("scores"))
    if known is None:
        return none
    at = windows.select("row", F.col("tid").cast("string").alias("tid"), "tname", F.col("w0").alias("st"), F.col("w1").alias("en"))
    if known.scores is not None:
        p = known.scores.select(F.col("rid").cast("string").alias("chrom"), F.when(F.col("strand") > 0, "+").otherwise("-").alias("strand"), "pos", (F.col("type") == "A").alias("acceptor"), F.col("score").cast("int").alias("score"))
        p = intervals.points_within(at.withColumnRenamed("tid", "chrom"), p, "pos").withColumn("pos", F.col("pos") - F.col("st"))
        got = p.groupBy("row").agg(F.collect_list(F.struct("pos", "strand", "acceptor", "score")).alias("scores"))
        return none.drop("scores").join(got, "row", "left")
    if known.introns is not None:
        i = known.introns.filter("strand in ('+', '-')").select("chrom", F.col("st").alias("a"), F.col("en").alias("b"), "strand").distinct()
        i = intervals.points_within(at.withColumnRenamed("tname", "chrom"), i, "a").filter(F.col("b") <= F.col("en"))
        got = i.groupBy("row").agg(F.collect_list(F.struct((F.col("a") - F.col("st")).alias("st"), (F.col("b") - F.col("st")).alias("en"), "strand")).alias("introns"))
        return none.drop("introns").join(got, "row", "left")
    return none


def _listed(values) -> list:
    return [] if values is None else list(values)


def _sites(x, o: Options, scored: bool) -> tuple[A.Sites, A.Sites]:
    """Ends of introns in a region's window, for transcripts of the target's strand and of the other one."""
    costs = A.plain_site_cost(o.noncanonical) if o.plain_sites else A.SITE_COST
    introns = [(p["st"], p["en"], p["strand"]) for p in _listed(x.introns)]
    scores = [(p["pos"], p["strand"], p["acceptor"], p["score"]) for p in _listed(x.scores)] if scored else None
    return tuple(A.splice_sites(x.target, turned, costs, introns, o.junction_bonus, scores, o.junction_penalty) for turned in (False, True))


def _alignments(x, o: Options, scoring: A.Scoring, scored: bool = False) -> list[tuple]:
    """One region's row, with its query and target window -> aligned rows: one, or its parts where the score falls, with
    what lies turned between them."""
    query = A.reverse_complement(x.qseq) if x.rev else x.qseq
    band, between = int(o.bw * 1.5 + 1), int(max(o.bw, o.bw_long) * 1.5 + 1)
    todo = [([(int(p["qpos"]), int(p["tpos"]) - x.w0, int(p["span"])) for p in x.places], o.zdrop)]
    out, rows = [], []
    forward, turned = _sites(x, o, scored) if o.spliced else (None, None)
    while todo:
        places, zdrop = todo.pop(0)
        got = A.align_chain(query, x.target, places, scoring, band, zdrop, o.spliced, between, end_bonus=o.end_bonus, sites=forward, reach=o.max_gap)
        got["trans"] = None
        if o.spliced:  # both strands of the transcript are tried
            other = A.align_chain(query, x.target, places, scoring, band, zdrop, True, between, turned=True, end_bonus=o.end_bonus, sites=turned, reach=o.max_gap)
            lead = got["dp_score"] - other["dp_score"]
            got = got if lead >= 0 else other
            got["trans"] = ("+" if (lead > 0) != bool(x.rev) else "-") if lead else None
        at = None
        if not (o.spliced or o.short_reads or o.forward_only or o.reverse_only):
            # a lesser fall parts the chain if what lies in it aligns on the other strand
            fall, (qa, ta), (qb, tb) = A.deepest_drop(got["cigar"], query[got["qs"] : got["qe"]], x.target[got["rs"] : got["re"]], scoring)
            if fall > o.zdrop_inv and 0 < min(qb - qa, tb - ta) and max(qb - qa, tb - ta) < o.max_gap:
                if A.inverted(query[got["qs"] + qa : got["qs"] + qb], x.target[got["rs"] + ta : got["rs"] + tb], scoring, max(o.min_dp_max, o.min_chain_score * o.match)):
                    at, zdrop = (qa, ta), o.zdrop_inv
        at = at or A.drops(got["cigar"], query[got["qs"] :], x.target[got["rs"] :], o.zdrop, scoring)
        cut = next((i for i, p in enumerate(places) if p[0] - p[2] + 1 >= got["qs"] + at[0]), 0) if at else 0
        if 0 < cut < len(places):  # aligned anew in two parts
            todo = [(places[:cut], zdrop), (places[cut:], zdrop), *todo]
            continue
        out.append((got, len(places), False, x.rev))
    parts = len(out) > 1
    for (a, *_), (b, *_) in zip(out[:-1], out[1:]):
        q, t = query[a["qe"] : b["qs"]], x.target[a["re"] : b["rs"]]
        if q and t and min(len(q), len(t)) >= o.k and A.inverted(q, t, scoring, o.min_dp_max):
            turned = A.best_local(A.reverse_complement(q), t, scoring)
            turned.update(qs=len(query) - b["qs"] + turned["qs"], qe=len(query) - b["qs"] + turned["qe"], rs=a["re"] + turned["rs"], re=a["re"] + turned["re"])
            out.append((turned, 0, True, 1 - x.rev))
    for got, cnt, inv, rev in out:
        text = A.reverse_complement(x.qseq) if rev else x.qseq
        part, target = text[got["qs"] : got["qe"]], x.target[got["rs"] : got["re"]]
        s = A.summary(got["cigar"], part, target, scoring, not (o.short_reads or o.spliced and o.fragments))
        if o.spliced and s["spliced"]:  # a strand that the sites tell counts in the read's favour
            s["dp_max"] = max(0, s["dp_max"] + (A.strand_bonus(scoring) if got.get("trans") else -(o.match + o.mismatch)))
        a, b = (x.qlen - got["qe"], x.qlen - got["qs"]) if rev else (got["qs"], got["qe"])
        score = x.score if not parts else max(1, x.score * cnt // max(1, len(x.places)))
        rows.append((x.qid, x.qname, x.qlen, x.tid, x.tname, x.tlen, rev, cnt, score, score, x.rep_len, a, b, got["rs"] + x.w0, got["re"] + x.w0, s["mlen"], s["blen"], got["dp_score"], s["dp_max"], s["nm"], s["n_ambi"],
                     round(1 - s["event_identity"], 6), inv, parts, bool(x.strand_retained) and not inv, 0 if inv else x.subsc, 0 if inv else x.n_sub, got.get("trans"), A.text(got["cigar"]), A.cs_tag(got["cigar"], part, target), A.cs_tag(got["cigar"], part, target, marked=True), A.md_tag(got["cigar"], part, target)))
    return rows


def _index(refs: DataFrame | Index, options: Options | str | None) -> Index:
    """An index as it is, one with other options (of the same sampling), or a new one."""
    if not isinstance(refs, Index):
        return build_index(refs, options)
    if options is None:
        return refs
    o, made = options if isinstance(options, Options) else preset(options), refs.options
    if (o.k, o.w, o.compressed) != (made.k, made.w, made.compressed):
        raise ValueError("the index was made with another k, w or compression")
    return Index(refs.seeds, refs.counts, refs.refs, o)


def _alternates(x: Index) -> DataFrame | None:
    return x.refs.select("rid", "is_alt") if "is_alt" in x.refs.columns else None


def written(found: DataFrame, o: Options) -> DataFrame:
    """What goes into files: without secondaries, where the options say so."""
    return found.filter(F.col("parent").isNull() | (F.col("parent") == F.col("rank"))) if o.no_secondary else found


def map_reads(reads: DataFrame, refs: DataFrame | Index, options: Options | str | None = None, with_alignment: bool = True, known: Known | None = None) -> DataFrame:
    """reads and refs: (rid, name, seq, ...), or refs as an index -> a row per mapping; ``known`` introns are for spliced reads.

    Coordinates are those of the strand as stored; qs and qe of the forward query. Regions are ranked and
    chosen by their chains, aligned against windows of the references, and then ranked, chosen and
    qualified anew by their alignments.
    """
    x = _index(refs, options)
    o = x.options
    reads = reads.drop("frag_id", "seg")
    q, rows = chained(reads, x)
    rows = regions.on_forward(rows.join(_lengths(reads).toDF("qid", "qlen"), "qid"))
    r = regions_of(rows, o, _alternates(x)).withColumn("score0", F.col("score")).drop("qlen")
    rep = seeding.repetitive_length(q.filter("not kept")).select(F.col("seq_id").alias("qid"), "rep_len")
    r = r.join(rep, "qid", "left").withColumn("rep_len", F.coalesce("rep_len", F.lit(0)).cast("long"))
    names = reads.select(F.col("rid").alias("qid"), F.col("name").alias("qname"), F.length("seq").cast("long").alias("qlen"), F.col("seq").alias("qseq"))
    targets = x.refs.select(F.col("rid").alias("tid"), F.col("name").alias("tname"), F.length("seq").cast("long").alias("tlen"))
    if not with_alignment:
        r = regions.sam_primary(regions.mapq(r, o.min_chain_score)).join(names.drop("qseq"), "qid").join(targets, "tid")
        return r.select("qid", "qname", "qlen", "tid", "tname", "tlen", "rev", "cnt", "score", "subsc", "n_sub", "rep_len", "mapq", "rank", "parent", "primary", "sam_pri", "qs", "qe", "rs", "re", "mlen", "blen")
    found = _aligned(r, names, x, o.min_cnt, known)
    if o.spliced and known is not None and known.jumps is not None:
        found = jumping.over_jumps(found, names.select("qid", "qseq"), x.refs, known.jumps, o.scoring(), target_windows, o.jump_min_match)
    return found


def _aligned(r: DataFrame, names: DataFrame, x: Index, min_cnt: int, known: Known | None = None) -> DataFrame:
    """Chosen chains, extents on the forward query -> aligned, filtered, ranked, chosen and qualified rows."""
    o = x.options
    targets = x.refs.select(F.col("rid").alias("tid"), F.col("name").alias("tname"), F.length("seq").cast("long").alias("tlen"))
    r = r.select("qid", "tid", "rev", "cnt", "score", "score0", "rep_len", "subsc", "n_sub", "strand_retained", "qs", "qe", "rs", "re", "places", F.struct("qid", "chain").alias("row")).join(names, "qid").join(targets, "tid")
    r = regions.on_forward(r)  # back to the strand that is aligned
    # as far as a band reaches; ends of spliced reads as far as their matches can pay for
    reach = F.lit(o.max_gap if o.spliced else int(o.bw * 1.5 + 1))
    before, after = (F.lit(0), F.lit(0)) if o.spliced else (F.col("qs"), F.col("qlen") - F.col("qe"))
    r = r.withColumn("w0", F.greatest(F.lit(0), F.col("rs") - before - reach)).withColumn("w1", F.least("tlen", F.col("re") + after + reach))
    r = cut(r)
    r = r.join(target_windows(r.select("row", "tid", "w0", "w1"), x.refs), "row")
    scored = o.spliced and known is not None and known.scores is not None
    if o.spliced:
        r = r.join(known_in(r.select("row", "tid", "tname", "w0", "w1"), known), "row")
    ship(x.refs.sparkSession)
    scoring, columns = o.scoring(), [c.split()[0] for c in ALIGNED.split(", ")]

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([row for y in pdf.itertuples(index=False) for row in _alignments(y, o, scoring, scored)], columns=columns)

    # few bytes, much work: by an expression, as a partitioning by row is there and would be kept in a few tasks
    r = r.repartition(tasks(x.refs.sparkSession), F.xxhash64("row"))
    return _qualified(regions.region_filter(r.mapInPandas(run, ALIGNED), min_cnt, o.min_chain_score, o.min_dp_max, o.max_clip), o, _alternates(x))


def _qualified(aligned: DataFrame, o: Options, alternates: DataFrame | None) -> DataFrame:
    out = regions.strand_filter(regions_of(aligned, o, alternates))
    out = regions.renumbered(out).withColumn("primary", F.col("parent") == F.col("rank"))
    short = o.short_reads or o.spliced and o.fragments
    return regions.mapq_aligned(regions.sam_primary(out), o.min_chain_score, o.match, short, o.spliced)


def map_pairs(reads: DataFrame, refs: DataFrame | Index, options: Options | str | None = None, known: Known | None = None) -> DataFrame:
    """(frag_id, seg, name, seq) -> mappings of both mates, with frag, seg and ``proper``.

    With ``fragments`` mates (which face each other) are chained as one query, the second one turned: a mate in a repeat is
    placed by the other. Chains are chosen as the fragment's, then split, and each mate's are aligned, ranked and
    qualified by themselves. Spliced reads, and mates without ``fragments``, are mapped apart and paired.
    """
    x = _index(refs, options)
    o = x.options
    single = reads.withColumn("rid", F.col("frag_id") * 2 + F.col("seg"))
    if o.fragments and not o.spliced:
        m = _map_fragments(single.select("rid", "frag_id", "seg", "name", "seq"), x)
    else:
        m = map_reads(single.select("rid", "name", "seq"), x, known=replace(known, jumps=None) if known else None)  # mates do not jump
    m = m.withColumn("frag", F.floor(F.col("qid") / 2).cast("long")).withColumn("seg", (F.col("qid") % 2).cast("int"))
    return regions.pair_up(m, o.max_gap_ref if o.max_gap_ref > 0 else max(o.max_gap, o.max_frag_len), o.pair_bonus, 2 * o.match + o.mismatch, o.match)


def _map_fragments(mates: DataFrame, x: Index) -> DataFrame:
    o = x.options
    turned = mates.withColumn("seq", F.when(F.col("seg") == 1, reverse_complement("seq")).otherwise(F.col("seq")))
    q, rows = chained(turned, x)
    n = lambda k: F.coalesce(F.max(F.when(F.col("seg") == k, F.length("seq"))), F.lit(0)).cast("long")
    ends = turned.groupBy(F.col("frag_id").alias("qid")).agg(n(0).alias("first"), n(1).alias("second")).withColumn("qlen", F.col("first") + F.col("second"))
    gap = F.lit(o.max_gap_ref) if o.max_gap_ref > 0 else F.greatest(F.lit(o.max_gap), F.lit(o.max_frag_len) - F.col("qlen"))
    ends = cut(ends.withColumn("frag_gap", gap.cast("long")))
    rows = regions.on_forward(rows.join(ends, "qid"))
    r = regions_of(rows, o, _alternates(x))
    rep = seeding.repetitive_length(q.filter("not kept")).select(F.col("seq_id").alias("qid"), "rep_len")
    r = r.join(rep, "qid", "left").withColumn("rep_len", F.coalesce("rep_len", F.lit(0)).cast("long"))
    r = regions.split_fragments(r.select("qid", "tid", "rev", "chain", "score", "rs", "re", "mlen", "blen", "places", "rep_len", "first", "second", "qs", "qe", "cnt"))
    r = regions_of(r.drop("first", "second", "seg"), o, _alternates(x), select=False).withColumn("score0", F.col("score")).drop("qlen")
    names = turned.select(F.col("rid").alias("qid"), F.col("name").alias("qname"), F.length("seq").cast("long").alias("qlen"), F.col("seq").alias("qseq"))
    out = _aligned(r, names, x, 0)
    second = F.col("qid") % 2 == 1  # back to the mate as it came
    back = {a: F.when(second, F.col("qlen") - F.col(b)).otherwise(F.col(a)) for a, b in (("qs", "qe"), ("qe", "qs"))}
    out = out.withColumns({**back, "rev": F.when(second, 1 - F.col("rev")).otherwise(F.col("rev")).cast("int")})
    return out.join(ends.select(F.col("qid").alias("_f"), "frag_gap"), F.floor(F.col("qid") / 2) == F.col("_f")).drop("_f")


def merged_parts(reads: DataFrame, parts: list[Index]) -> DataFrame:
    """Mappings to an index in several parts as those to the whole: ranked, chosen and qualified over all parts.

    The repetitive length is the greatest of the parts.
    """
    found = [map_reads(reads, p) for p in parts]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    o = parts[0].options
    rep = F.max("rep_len").over(Window.partitionBy("qid"))
    out = out.withColumn("rep_len", rep).drop("rank", "parent", "n_sub", "dp_max2", "primary", "sam_pri", "mapq", "hash", "rank_score", "is_alt")
    marks = [m for m in map(_alternates, parts) if m is not None]
    alternates = marks[0] if marks else None
    for m in marks[1:]:
        alternates = alternates.unionByName(m)
    return _qualified(out, o, alternates)


def extract_positions(spark, path: str, k: int = 31, s: int = 11) -> DataFrame:
    """(seq_id, start, pos) of closed syncmers of a file's sequences, in each stretch of bases."""
    return _stretches(spark, path, lambda x: sketch.syncmers(x, k, s))


def extract_full(spark, path: str, k: int = 31, s: int = 11) -> DataFrame:
    """The same with the mixed canonical k-mer at each place."""
    return _stretches(spark, path, lambda x: sketch.sampled_kmers(x, k, sampler="syncmer", s=s, mixed=True).withColumnRenamed("kmer", "hash"))


def _stretches(spark, path: str, sample) -> DataFrame:
    from ..sources.records import read_sequences

    reads = read_sequences(spark, path).select("rid", "seq")
    runs = sketch.runs_of_bases(reads, "rid", "seq")
    hits = sample(runs.select(F.struct("seq_id", "start").alias("seq_id"), "seq"))
    return hits.select(F.col("seq_id.seq_id").alias("rid"), (F.col("seq_id.start") + F.col("pos")).alias("pos"), *[c for c in hits.columns if c not in ("seq_id", "pos")])
