"""Minimizer index: a DataFrame (key, n, occ array<struct<rid, pos, strand>>), hashed by key."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NO_LIMIT = 2**31 - 1


def build(seeds: DataFrame) -> DataFrame:
    """Seeds grouped by key: count and occurrences in order. One shuffle, combined before it."""
    occ = F.sort_array(F.collect_list(F.struct(F.col("seq_id").alias("rid"), "pos", "strand")))
    return seeds.groupBy("key").agg(F.count("*").alias("n"), occ.alias("occ"))


def key_counts(seeds: DataFrame) -> DataFrame:
    """(key, n) without the occurrences, for statistics and cut-offs."""
    return seeds.groupBy("key").agg(F.count("*").alias("n"))


def stats(counts: DataFrame, total_length: int | DataFrame) -> DataFrame:
    """distinct keys, singletons, their percentage, mean occurrences, mean spacing, total length."""
    s = counts.agg(F.count("*").alias("distinct_keys"), F.sum((F.col("n") == 1).cast("long")).alias("singletons"), F.sum("n").alias("total_occ"))
    t = total_length if isinstance(total_length, DataFrame) else counts.sparkSession.range(1).select(F.lit(total_length).alias("total_length"))
    s = s.crossJoin(F.broadcast(t))  # two single rows
    return s.select("distinct_keys", "singletons", F.round(100 * F.col("singletons") / F.col("distinct_keys"), 4).alias("singleton_pct"),
                    F.round(F.col("total_occ") / F.col("distinct_keys"), 6).alias("avg_occ"), F.round(F.col("total_length") / F.col("total_occ"), 6).alias("avg_spacing"), "total_length")


def max_occ(counts: DataFrame, fraction: float) -> DataFrame:
    """One row: one more than the count at rank floor((1 - fraction) * keys), from 0; no limit if none.

    Counts are grouped first: there are far fewer different counts than keys.
    """
    if fraction <= 0:
        return counts.sparkSession.range(1).select(F.lit(NO_LIMIT).cast("long").alias("max_occ"))
    hist = counts.groupBy("n").agg(F.count("*").alias("keys"))
    upto = F.sum("keys").over(Window.orderBy("n"))
    every = F.sum("keys").over(Window.partitionBy())
    at = hist.select("n", upto.alias("upto"), every.alias("every")).filter(F.col("upto") > F.floor((1 - F.lit(float(fraction))) * F.col("every")))
    return at.agg(F.coalesce(F.min("n") + 1, F.lit(NO_LIMIT).cast("long")).alias("max_occ"))


def mid_occ(counts: DataFrame, fraction: float = 2e-4, least: int = 10, most: int = 1_000_000) -> DataFrame:
    """The cut-off clamped to a range."""
    return max_occ(counts, fraction).select(F.greatest(F.lit(least), F.least(F.lit(most), F.col("max_occ"))).cast("long").alias("mid_occ"))


def lookup(queries: DataFrame, index: DataFrame, cap: int | None = None) -> DataFrame:
    """Seeds of queries with their counts and occurrences; keys above ``cap`` are left out before the join."""
    idx = index if cap is None else index.filter(F.col("n") <= cap)
    return queries.join(idx, "key")


def name_to_id(refs: DataFrame) -> DataFrame:
    """(name, rid): of equal names the first one."""
    return refs.groupBy("name").agg(F.min("rid").alias("rid"))


def save(table: DataFrame, path: str, buckets: int | None = None) -> None:
    """A table with a column ``key`` as Parquet files bucketed and sorted by it, and beside them how they are laid out.

    One shuffle. By default there are as many buckets as the session has shuffle partitions, as Spark reads buckets in place only
    if they are as many at least. What lay there before is replaced, so a save that was interrupted is simply repeated.
    """
    spark = table.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    layout = {"buckets": n, "columns": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema)}
    name = _register(spark, f"{path}/entries", layout)
    table.repartition(n, "key").write.insertInto(name, overwrite=True)
    spark.sql(f"DROP TABLE {name}")  # the name only: the files stay
    spark.createDataFrame([(json.dumps(layout),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/layout")


def load(spark, path: str) -> DataFrame:
    """A table that ``save`` wrote. Joins and groups on its key shuffle the other side only: the table itself is read bucket by bucket."""
    return spark.table(_register(spark, f"{path}/entries", json.loads(spark.read.text(f"{path}/layout").first()[0])))


def _register(spark, path: str, layout: dict) -> str:
    """Files that are there or will be, under a new name in the session's catalog; without the catalog Spark knows no buckets."""
    name, place = f"strandline_{uuid.uuid4().hex}", path.replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} ({layout['columns']}) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {layout['buckets']} BUCKETS LOCATION '{place}'")
    return name


def merge_parts(parts: list[DataFrame]) -> DataFrame:
    """Hits of an index in several parts, rids shifted by the parts' sizes beforehand, as one table."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def collisions(kmers: DataFrame, k: int) -> DataFrame:
    """Different keys under the raw code, the masked hash and the one-round mix cut to 2k bits; hashes are taken of different k-mers only."""
    from ..functions.hashing import mixed64, with_masked_hash

    each = kmers.groupBy("kmer").agg(F.count("*").alias("seeds"))
    upper, lower = mixed64(F.col("kmer"))
    mixed = F.struct(upper.bitwiseAND(F.lit((1 << max(2 * k - 32, 0)) - 1)).alias("u"), lower.bitwiseAND(F.lit((1 << min(2 * k, 32)) - 1)).alias("l"))
    keys = with_masked_hash(each, "hash", "kmer", k).withColumn("mixed", mixed)
    return keys.agg(F.count("kmer").alias("raw_keys"), F.countDistinct("hash").alias("hash_keys"), F.countDistinct("mixed").alias("mixed_keys"), F.coalesce(F.sum("seeds"), F.lit(0)).alias("seeds"))
