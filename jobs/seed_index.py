"""Build the seed index of a table of sequences, for later look-ups that do not shuffle it.

``python -m jobs.seed_index SOURCE TARGET [--config FILE]``: SOURCE is a Parquet table of ids and texts, of which the bases
count. TARGET gets

* ``keys/frequent=...``: each key with its occurrences and the sequences that have it. Keys are frequent beyond a cut-off
  that is read off the counts of all keys;
* ``seeds``: the occurrences of the other keys, bucketed and sorted by key. Frequent keys have none there: no look-up wants
  them, and what a bucket holds of a key stays below the cut-off.

Everything is computed from the source as it is, and replaces what lay in TARGET, so a rerun, also one after a run that was
stopped half-way, gives the same. Rows without an id are sequences of the id null; null texts have no bases. An empty source gives empty tables.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from strandline.functions.seq import bases
from strandline.operators import index, sketch
from strandline.runtime import cut

log = logging.getLogger("jobs.seed_index")
#: So many keys may be broadcast (8 bytes each).
BROADCAST_KEYS = 200_000


def run(spark: SparkSession, source: str, target: str, config: dict) -> dict:
    """Returns what it logs: sequences, bases and seeds read; cut-off, keys, frequent keys and occurrences written."""
    read = Observation("read")
    texts = spark.read.parquet(source).select(F.col(config["id"]).cast("long").alias("seq_id"), bases(config["text"]).alias("seq"))
    texts = texts.observe(read, F.count("*").alias("sequences"), F.coalesce(F.sum(F.length("seq")), F.lit(0)).alias("bases"))
    sampled = cut(sketch.seeds(texts, config["k"], config["w"]))
    # a key's occurrences are counted a sequence at a time, so a key that all of them have is combined before any shuffle
    counts = cut(sampled.groupBy("key", "seq_id").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("n_seqs")))
    cap = index.mid_occ(counts, config["frequent_fraction"], config["min_cap"], config["max_cap"]).first()[0]
    counts.withColumn("frequent", F.col("n") > cap).write.mode("overwrite").partitionBy("frequent").parquet(f"{target}/keys")
    written = dict(keys(spark, target).groupBy("frequent").count().collect())  # two rows, from the footers
    frequent = counts.filter(F.col("n") > cap).select("key")
    if written.get(True, 0) <= BROADCAST_KEYS:  # their occurrences then go before the shuffle; else AQE splits them
        frequent = F.broadcast(frequent)
    rare = sampled.join(frequent, "key", "left_anti")
    index.save(rare, f"{target}/seeds", config["buckets"])
    done = {**read.get, "cap": cap, "keys": sum(written.values()), "frequent": written.get(True, 0), "occurrences": seeds(spark, target).count()}
    log.info("read %s: %d sequences, %d bases", source, done["sequences"], done["bases"])
    log.info("wrote %s: cut-off %d, %d keys (%d frequent), %d occurrences", target, cap, done["keys"], done["frequent"], done["occurrences"])
    return done


def keys(spark: SparkSession, target: str) -> DataFrame:
    """(key, n, n_seqs, frequent) as written; of an empty source without rows."""
    return spark.read.schema("key long, n long, n_seqs long, frequent string").parquet(f"{target}/keys").withColumn("frequent", F.col("frequent") == "true")


def seeds(spark: SparkSession, target: str) -> DataFrame:
    """(seq_id, key, span, pos, strand) of the keys that are not frequent; read in place by joins on key."""
    return index.load(spark, f"{target}/seeds")


def output(spark: SparkSession, target: str) -> DataFrame:
    """Both tables as one: each key with its first and last sequence and the sum of its places (null for frequent ones)."""
    places = seeds(spark, target).groupBy("key").agg(F.min("seq_id").alias("first_id"), F.max("seq_id").alias("last_id"), F.sum("pos").alias("pos_sum"), F.sum("strand").alias("reverse"))
    return keys(spark, target).join(places, "key", "left").select("key", "n", "n_seqs", "frequent", "first_id", "last_id", "pos_sum", "reverse")


if __name__ == "__main__":
    from jobs import command_line

    command_line("seed_index", __doc__.splitlines()[0], ["source", "target"], run)
