"""From query seeds and an index to anchors: filters before the join, the join, coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tandem(seeds: DataFrame) -> DataFrame:
    """Flag seeds whose key the previous or the next seed of the query has."""
    w = Window.partitionBy("seq_id").orderBy("pos")
    same = lambda c: F.coalesce(c.over(w) == F.col("key"), F.lit(False))
    return seeds.withColumn("tandem", same(F.lag("key")) | same(F.lead("key")))


def query_frequency_filter(seeds: DataFrame, most: int | Column, fraction: float = 0.01) -> DataFrame:
    """Drop keys that a query has more than ``most`` times and in more than a share of its seeds."""
    own, all_ = Window.partitionBy("seq_id", "key"), Window.partitionBy("seq_id")
    s = seeds.withColumn("_n", F.count("*").over(own)).withColumn("_all", F.count("*").over(all_))
    return s.filter(~((F.col("_n") > most) & (F.col("_n") > F.col("_all") * fraction))).drop("_n", "_all")


def select_streaks(hits: DataFrame, lengths: DataFrame, max_occ: int | Column, max_max_occ: int, dist: int) -> DataFrame:
    """(seq_id, pos, n) -> with ``kept``: of each streak of frequent seeds the rarest few.

    A streak lies between two seeds that occur at most ``max_occ`` times (or a query's end); it keeps
    one seed per ``dist`` bases, 128 at most, the rarest first, then by place. Seeds that occur more
    than ``max_max_occ`` times go in any case.
    """
    h = hits.join(lengths, "seq_id").withColumn("_bad", F.col("n") > max_occ)
    if dist <= 0 or isinstance(max_occ, int) and max_max_occ <= max_occ:
        return h.withColumn("kept", ~F.col("_bad")).drop("_bad", "length")
    w = Window.partitionBy("seq_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    h = h.withColumn("_good", F.when(~F.col("_bad"), F.col("pos")))
    h = h.withColumns({
        "_streak": F.sum((~F.col("_bad")).cast("long")).over(w),
        "_from": F.coalesce(F.last("_good", True).over(w), F.lit(0)),
        # a frame that goes on to the end would be gone through again for every seed
        "_to": F.coalesce("_good", F.expr("lead(_good) IGNORE NULLS OVER (PARTITION BY seq_id ORDER BY pos)"), F.col("length")),
    })
    k = F.least(F.lit(128), F.floor((F.col("_to") - F.col("_from")) / F.lit(float(dist)) + 0.499))
    h = h.withColumn("_k", k).drop("_good", "_from", "_to", "length")
    rank = F.row_number().over(Window.partitionBy("seq_id", "_streak", "_bad").orderBy("n", "pos"))
    kept = ~F.col("_bad") | (rank <= F.col("_k")) & (F.col("n") <= max_max_occ)
    return h.withColumn("kept", kept).drop("_bad", "_streak", "_k")


def repetitive_length(filtered: DataFrame) -> DataFrame:
    """(seq_id, rep_len): bases that the spans of filtered seeds cover, overlaps once."""
    s = filtered.select("seq_id", (F.col("pos") - F.col("span") + 1).alias("st"), (F.col("pos") + 1).alias("en"))
    before = Window.partitionBy("seq_id").orderBy("st", "en").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("reach", F.coalesce(F.max("en").over(before), F.lit(0)))
    return s.groupBy("seq_id").agg(F.sum(F.greatest(F.lit(0), F.col("en") - F.greatest("st", "reach"))).alias("rep_len"))


def too_frequent(targets: DataFrame, cap: int | DataFrame) -> DataFrame:
    """Keys that targets have more than ``cap`` times."""
    n = targets.groupBy("key").agg(F.count("*").alias("n"))
    if isinstance(cap, DataFrame):
        n = n.crossJoin(F.broadcast(cap.toDF("cap")))  # a single row
    return n.filter(F.col("n") > (F.col("cap") if isinstance(cap, DataFrame) else cap)).select("key")


def with_names(anchors_df: DataFrame, queries: DataFrame, targets: DataFrame) -> DataFrame:
    """Anchors with qname, qlen, tname and tlen; queries and targets: (rid, name, length)."""
    q = queries.select(F.col("rid").alias("qid"), F.col("name").alias("qname"), F.col("length").alias("qlen"))
    t = targets.select(F.col("rid").alias("tid"), F.col("name").alias("tname"), F.col("length").alias("tlen"))
    return anchors_df.join(q, "qid").join(t, "tid")


def anchors(queries: DataFrame, targets: DataFrame, query_lengths: DataFrame, cap: int | DataFrame | None = None) -> DataFrame:
    """(qid, tid, rev, tpos, qpos, span): equal keys of queries and targets.

    ``targets`` are seeds; keys with more than ``cap`` of them (a number, or a table of one) go before the
    join, which keeps a frequent key from making the product of its two sides. On the other strand a query's place is
    counted from its end.
    """
    t = targets.select("key", F.col("seq_id").alias("tid"), F.col("pos").alias("tpos"), F.col("strand").alias("tstrand"))
    if cap is not None:
        t = t.join(too_frequent(targets, cap), "key", "left_anti")
    more = [c for c in ("seg",) if c in queries.columns]  # which mate of a fragment a seed is of
    q = queries.select("key", F.col("seq_id").alias("qid"), "pos", "span", "strand", *more).join(query_lengths.withColumnRenamed("seq_id", "qid"), "qid")
    a = q.join(t, "key").withColumn("rev", (F.col("strand") != F.col("tstrand")).cast("int"))
    place = F.when(F.col("rev") == 0, F.col("pos")).otherwise(F.col("length") - (F.col("pos") + 1 - F.col("span")) - 1)
    return a.select("qid", "tid", "rev", "tpos", place.alias("qpos"), "span", *more)


def merged_order(anchors_df: DataFrame) -> DataFrame:
    """Anchors of a query in target order, as a merge of its occurrence lists has them."""
    return anchors_df.orderBy("qid", "rev", "tid", "tpos", "qpos")


def no_diagonal(anchors_df: DataFrame) -> DataFrame:
    """Without a sequence's seeds on itself at the same place: the same name and length (see ``with_names``)."""
    return anchors_df.filter(~((F.col("qname") == F.col("tname")) & (F.col("qlen") == F.col("tlen")) & (F.col("rev") == 0) & (F.col("qpos") == F.col("tpos"))))


def no_dual(anchors_df: DataFrame) -> DataFrame:
    """Each pair of sequences once: queries whose name comes after the target's are skipped."""
    return anchors_df.filter(F.col("qname") <= F.col("tname"))


def strand_only(anchors_df: DataFrame, reverse: bool) -> DataFrame:
    return anchors_df.filter(F.col("rev") == int(reverse))


def fragment_offsets(segments: DataFrame) -> DataFrame:
    """(frag_id, seg, length) -> with ``offset``: where a segment begins in its fragment."""
    w = Window.partitionBy("frag_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    return segments.withColumn("offset", F.coalesce(F.sum("length").over(w), F.lit(0)))


def split_by_segment(anchors_df: DataFrame, offsets: DataFrame) -> DataFrame:
    """Anchors of a fragment as anchors of the segment that holds them, in its coordinates."""
    a = anchors_df.join(offsets, anchors_df.qid == offsets.frag_id)
    inside = (F.col("qpos") >= F.col("offset")) & (F.col("qpos") < F.col("offset") + F.col("length"))
    return a.filter(inside).select("qid", "seg", "tid", "rev", "tpos", (F.col("qpos") - F.col("offset")).alias("qpos"), "span")
