"""Ends of spliced alignments carried on over known junctions: a few bases that no seed or score finds by themselves."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.seq import reverse_complement
from ..runtime import cut, ship
from . import alignment as A
from . import intervals

#: The least match at an alignment's end beyond the overlap, and the shortest intron.
MIN_EXON, MIN_INTRON = 20, 6
#: Flag of jumps that come from annotation; they go before others.
ANNOTATED = 1


def _wrong(a: Column, b: Column) -> Column:
    """How many letters of two texts of one length differ or are no bases."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y) | ~x.isin("A", "C", "G", "T"))
    return F.when(F.length(b) == 0, 0).otherwise(F.size(F.filter(pairs, lambda x: x)))


def _side(m: DataFrame, reads: DataFrame, refs: DataFrame, jumps: DataFrame, s: A.Scoring, windows, least: int, left: bool) -> DataFrame:
    """One end of every alignment; ``changed`` tells which were."""
    ext = 1 + (s.mismatch + s.match - 1) // s.match + 1
    forward = F.col("rev") == 0
    clip = F.when(forward, F.col("qs")).otherwise(F.col("qlen") - F.col("qe")) if left else F.when(forward, F.col("qlen") - F.col("qe")).otherwise(F.col("qs"))
    edge = F.col("rs") if left else F.col("re")
    exon = F.coalesce(F.expr(f"try_cast(regexp_extract(cigar, '{'^([0-9]+)M' if left else '([0-9]+)M$'}', 1) as long)"), F.lit(0))
    space = F.col("rs") if left else F.col("tlen") - F.col("re")
    m = m.withColumns({"_clip": clip, "_exon": exon, "_row": F.struct("qid", "rank")})
    near = F.least("_clip", F.lit(ext))
    ends = m.filter((F.col("_exon") > ext + MIN_EXON) & (F.col("_clip") < space)).select(
        "_row", "qid", "tid", "rev", "qlen", "tlen", edge.alias("_edge"), "_clip", F.col("tname").alias("chrom"),
        (edge - (near if left else ext)).alias("st"), (edge + (ext if left else near)).alias("en"))
    c = intervals.points_within(ends, jumps, "off", closed_end=True, open_start=True)
    off, off2, n = F.col("off"), F.col("off2"), F.col("_clip") + ext
    if left:
        c = c.filter((off - off2 >= MIN_INTRON) & (off2 >= n)).withColumn("_size", F.col("_clip") + off - F.col("_edge"))
        far, close = (off2 - F.col("_size"), off2), (off, F.col("_edge") + ext)
    else:
        c = c.filter((off2 - off >= MIN_INTRON) & (off2 + n <= F.col("tlen"))).withColumn("_size", F.col("_clip") + F.col("_edge") - off)
        far, close = (off2, off2 + F.col("_size")), (F.col("_edge") - ext, off)
    c = cut(c.withColumns({"_f0": far[0], "_f1": far[1], "_c0": close[0], "_c1": close[1]}))
    key = lambda part: F.struct("_row.qid", "_row.rank", "off", "off2", F.lit(part).alias("part"))
    need = c.select(key(0).alias("row"), "tid", F.col("_f0").alias("w0"), F.col("_f1").alias("w1")).union(c.filter("_c1 > _c0").select(key(1).alias("row"), "tid", F.col("_c0").alias("w0"), F.col("_c1").alias("w1")))
    got = windows(need, refs).groupBy("row.qid", "row.rank", "row.off", "row.off2").agg(
        F.max(F.when(F.col("row.part") == 0, F.upper("target"))).alias("_far"), F.coalesce(F.max(F.when(F.col("row.part") == 1, F.upper("target"))), F.lit("")).alias("_close"))
    c = c.withColumn("rank", F.col("_row.rank")).join(got, ["qid", "rank", "off", "off2"]).join(reads, "qid")
    first = (F.col("rev") == 0) if left else (F.col("rev") == 1)  # whether the end is the one the read begins with
    piece = F.upper(F.when(first, F.substring("qseq", F.lit(1), n.cast("int"))).otherwise(F.substring("qseq", (F.col("qlen") - n + 1).cast("int"), n.cast("int"))))
    c = c.withColumn("_q", F.when(F.col("rev") == 0, piece).otherwise(reverse_complement(piece)))
    size = F.col("_size").cast("int")
    rest = (n - F.col("_size")).cast("int")
    q_far, q_close = (F.substring("_q", F.lit(1), size), F.substring("_q", size + 1, rest)) if left else (F.substring("_q", rest + 1, size), F.substring("_q", F.lit(1), rest))
    c = c.withColumn("_mm", _wrong(q_close, F.col("_close"))).filter((q_far == F.col("_far")) & ~q_far.rlike("[^ACGT]") & (F.col("_mm") <= 1))
    item = F.struct("off", "off2", "_mm")
    best = (F.max if left else F.min)  # the jump nearest to the alignment's middle
    known = (F.col("flag").cast("int").bitwiseAND(ANNOTATED)) != 0
    g = c.groupBy("qid", "rank").agg(F.count_if(known).alias("_a"), F.count_if(~known).alias("_b"), best(F.when(known, item)).alias("_ja"), best(F.when(~known, item)).alias("_jb"))
    g = g.select("qid", "rank", F.when(F.col("_a") > 0, F.col("_a")).otherwise(F.col("_b")).alias("_n"), F.when(F.col("_a") > 0, F.col("_ja")).otherwise(F.col("_jb")).alias("_j"))
    m = m.join(g, ["qid", "rank"], "left")
    moved = (F.col("_j.off") - edge) if left else (edge - F.col("_j.off"))  # negative where the junction lies in what was clipped
    m = m.withColumn("_l", moved)
    jump = F.coalesce((F.col("_n") == 1) & (F.col("_clip") + F.col("_l") >= least), F.lit(False))
    trim = F.coalesce(~jump & (F.col("_l") > 0), F.lit(False))
    new = (F.col("_clip") + F.col("_l")).cast("string")
    kept = F.concat((F.col("_exon") - F.col("_l")).cast("string"), F.lit("M"))
    intron = F.concat(F.abs(F.col("_j.off") - F.col("_j.off2")).cast("string"), F.lit("N"))
    if left:
        tail = F.regexp_replace("cigar", "^[0-9]+M", "")
        cigar, short = F.concat(new, F.lit("M"), intron, kept, tail), F.concat(kept, tail)
        place, moved_to = "rs", (F.col("_j.off2") - F.col("_clip") - F.col("_l"), F.col("rs") + F.col("_l"))
    else:
        head = F.regexp_replace("cigar", "[0-9]+M$", "")
        cigar, short = F.concat(head, kept, intron, new, F.lit("M")), F.concat(head, kept)
        place, moved_to = "re", (F.col("_j.off2") + F.col("_clip") + F.col("_l"), F.col("re") - F.col("_l"))
    at_begin = forward if left else ~forward
    gain = (F.col("_clip") - F.col("_j._mm")) * s.match - F.col("_j._mm") * s.mismatch + F.when(F.col("cigar").contains("N"), 0).otherwise(A.strand_bonus(s))
    m = m.withColumns({
        "cigar": F.when(jump, cigar).when(trim, short).otherwise(F.col("cigar")),
        place: F.when(jump, moved_to[0]).when(trim, moved_to[1]).otherwise(F.col(place)),
        "qs": F.when(at_begin & jump, 0).when(at_begin & trim, F.col("qs") + F.col("_l")).otherwise(F.col("qs")),
        "qe": F.when(~at_begin & jump, F.col("qlen")).when(~at_begin & trim, F.col("qe") - F.col("_l")).otherwise(F.col("qe")),
        "dp_max": F.when(jump, F.col("dp_max") + gain).otherwise(F.col("dp_max")),
        "changed": F.col("changed") | jump | trim,
    })
    return m.drop("_clip", "_exon", "_row", "_n", "_j", "_l")


def over_jumps(found: DataFrame, reads: DataFrame, refs: DataFrame, jumps: DataFrame, s: A.Scoring, windows, least: int = 3) -> DataFrame:
    """Aligned spliced reads whose ends are carried on over known junctions.

    found: as ``mapper.map_reads`` gives; reads (qid, qseq); jumps (chrom, off, off2, flag); ``windows`` cuts (row, tid, w0, w1)
    out of refs. A junction near an alignment's end is taken if what was clipped (and what lay beyond the junction) continues
    exactly on its other side, and what is left at this side has one mismatch at most. Annotated junctions go before others; of
    several the place is not known, so what lies beyond the junction is clipped instead. At least ``least`` bases have to move.
    """
    columns = found.columns
    jumps = jumps.groupBy("chrom", "off", "off2").agg(F.bit_or("flag").alias("flag"))
    m = cut(found).withColumn("changed", F.lit(False))
    m = cut(_side(m, reads, refs, jumps, s, windows, least, True))
    m = cut(_side(m, reads, refs, jumps, s, windows, least, False))
    again = m.filter("changed").withColumn("row", F.struct("qid", "rank"))
    again = again.join(windows(again.select("row", "tid", F.col("rs").alias("w0"), F.col("re").alias("w1")), refs), "row").join(reads, "qid")
    new = "qid long, rank long, mlen long, blen long, nm long, n_ambi long, div double, cs string, ds string, md string"
    names = [c.split()[0] for c in new.split(", ")]
    ship(refs.sparkSession)

    def run(batches):
        for pdf in batches:
            rows = []
            for x in pdf.itertuples(index=False):
                q = x.qseq[x.qs : x.qe]
                q, c = A.reverse_complement(q) if x.rev else q, A.parse(x.cigar)
                k = A.summary(c, q, x.target, s)
                rows.append((x.qid, x.rank, k["mlen"], k["blen"], k["nm"], k["n_ambi"], round(1 - k["event_identity"], 6), A.cs_tag(c, q, x.target), A.cs_tag(c, q, x.target, marked=True), A.md_tag(c, q, x.target)))
            yield pd.DataFrame(rows, columns=names)

    fresh = again.select("qid", "rank", "rev", "qs", "qe", "cigar", "target", "qseq").mapInPandas(run, new)
    m = m.filter("changed").drop(*names[2:]).join(fresh, ["qid", "rank"]).unionByName(m.filter("not changed"))
    types = dict(found.dtypes)
    return m.select(*[F.col(c).cast(types[c]).alias(c) for c in columns])
