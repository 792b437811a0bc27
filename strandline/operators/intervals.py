"""Introns, junctions, splice scores and masked stretches: tables of intervals and joins on them.

Range joins are equi-joins on bins of positions plus the exact condition, so they shuffle by contig
and bin instead of comparing everything on a contig.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Places of a bin; so few that a region meets hardly more points than lie in it.
BIN = 2048


def introns_of_bed12(bed: DataFrame, least_score: int = 0) -> DataFrame:
    """(chrom, start, end, score, strand, block_sizes, block_starts) -> (chrom, st, en, score, strand, cnt): gaps between blocks."""
    nums = lambda c: F.transform(F.filter(F.split(c, ","), lambda x: x != ""), lambda x: x.cast("long"))
    b = bed.filter(F.col("score") >= least_score).withColumn("s", nums(F.col("block_sizes"))).withColumn("o", nums(F.col("block_starts")))
    b = b.filter(F.size("s") > 1)
    k = F.sequence(F.lit(1), F.size("s") - 1)
    gaps = F.transform(k, lambda i: F.struct(
        (F.col("start") + F.element_at("o", i) + F.element_at("s", i)).alias("st"), (F.col("start") + F.element_at("o", i + 1)).alias("en")))
    g = b.select("chrom", "score", "strand", F.explode(gaps).alias("g")).select("chrom", "g.st", "g.en", "score", "strand")
    return merge_introns(g)


def merge_introns(introns: DataFrame) -> DataFrame:
    """Equal (contig, st, en) once, with how often it came, the best score, and a strand if they agree."""
    one = F.min("strand") == F.max("strand")
    return introns.groupBy("chrom", "st", "en").agg(F.count("*").alias("cnt"), F.max("score").alias("score"), F.when(one, F.min("strand")).otherwise(".").alias("strand"))


def jumps(introns: DataFrame, flag: int) -> DataFrame:
    """Each intron as two directed jumps: (chrom, off, off2, cnt, strand, flag)."""
    a = introns.select("chrom", F.col("st").alias("off"), F.col("en").alias("off2"), "cnt", "strand", F.lit(flag).alias("flag"))
    return a.union(a.select("chrom", F.col("off2").alias("off"), F.col("off").alias("off2"), "cnt", "strand", "flag"))


def merge_jumps(*sources: DataFrame) -> DataFrame:
    """Jumps of several sources: counts added, flags joined."""
    all_ = sources[0]
    for s in sources[1:]:
        all_ = all_.union(s)
    return all_.groupBy("chrom", "off", "off2").agg(F.sum("cnt").alias("cnt"), F.bit_or("flag").alias("flag"))


def splice_scores(raw: DataFrame, refs: DataFrame, most: int = 63, scale: float = 1.0) -> DataFrame:
    """(chrom, pos, strand, type, score) -> with rid, scores scaled, rounded half away from zero and clamped.

    Unknown contigs and places outside them go; a strand is 1 for '+', else -1.
    """
    x = F.col("score") * scale
    whole = F.when(x >= 0, F.floor(x + 0.5)).otherwise(-F.floor(-x + 0.5))
    s = raw.join(refs.select(F.col("name").alias("chrom"), "rid", "len"), "chrom").filter((F.col("pos") >= 0) & (F.col("pos") < F.col("len")))
    return s.select("rid", F.when(F.col("strand") == "+", 1).otherwise(-1).alias("strand"), "pos", "type", F.greatest(F.lit(-most), F.least(F.lit(most), whole)).cast("int").alias("score"))


def mark_alt(refs: DataFrame, alt_names: DataFrame) -> DataFrame:
    """is_alt for the contigs on a list."""
    marks = alt_names.select("name").distinct().withColumn("_alt", F.lit(True))
    return refs.join(marks, "name", "left").withColumn("is_alt", F.coalesce("_alt", F.lit(False))).drop("_alt")


def _binned(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """A row for each bin that [a, b] touches."""
    return df.withColumn("_bin", F.explode(F.sequence(F.floor(a / BIN), F.floor(b / BIN))))


def points_within(regions: DataFrame, points: DataFrame, place: str, closed_end: bool = False, open_start: bool = False) -> DataFrame:
    """Pairs of a region (chrom, st, en) and a point with st <= place < en; either end may be moved by one."""
    r = _binned(regions, F.col("st"), F.col("en"))
    p = points.withColumn("_bin", F.floor(F.col(place) / BIN))
    low = F.col(place) > F.col("st") if open_start else F.col(place) >= F.col("st")
    high = F.col(place) <= F.col("en") if closed_end else F.col(place) < F.col("en")
    return r.join(p, ["chrom", "_bin"]).filter(low & high).drop("_bin")


def _by_place(regions: DataFrame, found, merged: Column, more: DataFrame | None = None) -> DataFrame:
    """(region_id, pos, value) of regions of which ``found`` gives each place once, so that only the rows of ids that several
    regions have, or that ``more`` has rows of, are grouped."""
    ids = regions.groupBy("region_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("region_id").alias("_id"))
    if more is not None:
        ids = ids.union(more.select("region_id")).distinct()
    r = regions.join(ids.withColumn("_many", F.lit(True)), F.col("region_id").eqNullSafe(F.col("_id")), "left").drop("_id")
    many = found(r.filter("_many").drop("_many"))
    if more is not None:
        many = many.unionByName(more)
    return found(r.filter("_many is null").drop("_many")).unionByName(many.groupBy("region_id", "pos").agg(merged))


def annotate_splice_signals(regions: DataFrame, introns: DataFrame) -> DataFrame:
    """(region_id, pos, bits): introns inside a region mark their ends, 1 and 2 on the plus strand, 8 and 4 on the minus.

    A begin is marked if the shortest intron from there ends in the region, an end if the shortest up to there begins in it, so
    introns are reduced to places before they meet regions. Introns that end before they begin mark places outside too and are
    joined as they are.
    """
    plus = F.coalesce(F.col("strand") == "+", F.lit(False))
    i = introns.select("chrom", F.col("st").alias("ist"), F.col("en").alias("ien"), plus.alias("plus"))
    none = F.lit(None).cast("long")
    ends = F.array(F.struct(F.col("ist").cast("long").alias("place"), F.col("ien").cast("long").alias("to"), none.alias("from")),
                   F.struct((F.col("ien") - 1).cast("long").alias("place"), none.alias("to"), F.when(F.col("ist") < F.col("ien"), F.col("ist").cast("long")).alias("from")))
    e = i.select("chrom", "plus", F.inline(ends))
    marks = e.groupBy("chrom", "place").agg(F.min(F.when(F.col("plus"), F.col("to"))).alias("to1"), F.min(F.when(~F.col("plus"), F.col("to"))).alias("to8"),
                                            F.max(F.when(F.col("plus"), F.col("from"))).alias("from2"), F.max(F.when(~F.col("plus"), F.col("from"))).alias("from4"))
    bit = lambda ok, b: F.when(ok, b).otherwise(0)
    bits = (bit(F.col("to1") <= F.col("en"), 1).bitwiseOR(bit(F.col("to8") <= F.col("en"), 8))
            .bitwiseOR(bit(F.col("from2") >= F.col("st"), 2)).bitwiseOR(bit(F.col("from4") >= F.col("st"), 4)))

    def found(r):
        return points_within(r, marks, "place").select("region_id", (F.col("place") - F.col("st")).alias("pos"), bits.alias("bits")).filter("bits <> 0")

    turned = points_within(regions, i.filter("ist >= ien").distinct(), "ist").filter(F.col("ien") <= F.col("en"))
    turned = turned.select("region_id", (F.col("ien") - 1 - F.col("st")).alias("pos"), F.when(F.col("plus"), 2).otherwise(4).alias("bits"))
    return _by_place(regions, found, F.bit_or("bits").alias("bits"), turned)


def jumps_in(regions: DataFrame, jump_table: DataFrame) -> DataFrame:
    """(region_id, off, off2, cnt, flag) with st < off <= en."""
    return points_within(regions, jump_table, "off", closed_end=True, open_start=True).select("region_id", "off", "off2", "cnt", "flag")


def best_splice_scores(regions: DataFrame, scores: DataFrame) -> DataFrame:
    """(region_id, pos, score): the best score at each place of a region; of each place of a contig it is taken before regions meet it."""
    best = scores.groupBy("chrom", "pos").agg(F.max("score").alias("score"))

    def found(r):
        return points_within(r, best, "pos").select("region_id", (F.col("pos") - F.col("st")).alias("pos"), "score")

    return _by_place(regions, found, F.max("score").alias("score"))
