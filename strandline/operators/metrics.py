"""Audits of hit sets and summaries of measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def marker_audit(hits: DataFrame, lengths: DataFrame, k: int) -> DataFrame:
    """Per sequence: hits, those out of bounds, share of adjacent ones closer than k, bases covered."""
    w = Window.partitionBy("seq_id").orderBy("pos")
    gap = F.col("pos") - F.lag("pos").over(w)
    h = hits.join(lengths, "seq_id").withColumn("gap", gap)
    new = F.least(F.coalesce("gap", F.lit(k)), F.lit(k))
    g = h.groupBy("seq_id", "length").agg(
        F.count("*").alias("hits"), F.sum((F.col("pos") + k > F.col("length")).cast("long")).alias("out_of_bounds"),
        F.sum((F.col("gap") < k).cast("long")).alias("close"), F.sum(new).alias("covered"))
    return g.select("seq_id", "hits", "out_of_bounds", F.coalesce("close", F.lit(0)).alias("close"), "covered", F.round(F.col("covered") / F.col("length"), 6).alias("coverage"))


def set_comparison(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """One row: sizes, common elements, Jaccard similarity, and the share of a that b conserves."""
    x = a.select(*on).distinct().withColumn("in_a", F.lit(1))
    y = b.select(*on).distinct().withColumn("in_b", F.lit(1))
    both = x.unionByName(y, allowMissingColumns=True).groupBy(*on).agg(F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"))
    c = both.agg(F.count("in_a").alias("size_a"), F.count("in_b").alias("size_b"), F.sum((F.col("in_a") + F.col("in_b") == 2).cast("long")).alias("common"), F.count("*").alias("total"))
    return c.select("size_a", "size_b", F.coalesce("common", F.lit(0)).alias("common"), F.round(F.coalesce("common", F.lit(0)) / F.col("total"), 6).alias("jaccard"),
                    F.round(F.coalesce("common", F.lit(0)) / F.col("size_a"), 6).alias("conserved"))


def scaling(runs: DataFrame) -> DataFrame:
    """(tool, threads, value) -> mean, deviation, speed-up on one thread and efficiency."""
    m = runs.groupBy("tool", "threads").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"))
    one = m.filter("threads = 1").select("tool", F.col("mean").alias("single"))
    m = m.join(one, "tool", "left")
    return m.select("tool", "threads", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), F.round(F.col("mean") / F.col("single"), 6).alias("speedup"),
                    F.round(F.col("mean") / (F.col("threads") * F.col("single")), 6).alias("efficiency"))


def tolerance(measured: DataFrame, warn: float, fail: float) -> DataFrame:
    """(name, expected, value) -> relative deviation in per cent, and ok, warn or fail."""
    d = 100 * F.abs(F.col("value") - F.col("expected")) / F.abs(F.col("expected"))
    return measured.withColumn("deviation", F.round(d, 6)).withColumn("status", F.when(d <= warn, "ok").when(d <= fail, "warn").otherwise("fail"))


def grid_summary(runs: DataFrame, *by: str) -> DataFrame:
    """Mean and deviation at each point of a sweep."""
    return runs.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("value"), F.lit(0.0)), 6).alias("std"))


def scan_totals(hits: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row: sequences, bases, hits, density, and an order-free digest of the places."""
    h = hits.agg(F.count("*").alias("hits"), F.coalesce(F.bit_xor((F.col("seq_id") * 1_000_003 + F.col("pos")) % 2147483647), F.lit(0)).alias("digest"))
    n = lengths.agg(F.count("*").alias("sequences"), F.coalesce(F.sum("length"), F.lit(0)).alias("bases"))
    return n.crossJoin(h).select("sequences", "bases", "hits", F.round(F.col("hits") / F.col("bases"), 6).alias("density"), "digest")  # two single rows
