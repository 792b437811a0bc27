"""Screen reads as they arrive against a panel of references: which reference shares most of a read's seeds?

``python -m jobs.read_screen READS PANEL TARGET CHECKPOINT [--config FILE]``: READS is a folder (or pattern) of Parquet files
that grows, PANEL what `jobs.seed_index` wrote for the references. Each run takes the files that are new since the last one
(a file stream with a checkpoint, until nothing is left) and adds to TARGET, by ``batch`` and ``call``:

    id, n_keys (different seeds of the read), n_found (of them in the panel), best_id (reference that shares most, of equal
    ones the lesser id), shared (with it), share (of n_keys), call (``match`` or ``clean``)

A batch overwrites its own partitions, and its rows follow from its files alone, so a batch that is repeated after a failure
leaves no row twice. Reads without an id have nothing to be reported by and are counted in the log only; rows of one id
within a batch are one read; a null text has no seeds and is clean.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobs import seed_index
from strandline.functions.seq import bases
from strandline.operators import sketch
from strandline.runtime import cut

log = logging.getLogger("jobs.read_screen")
OUTPUT = "id long, n_keys long, n_found long, best_id long, shared long, share double, batch long, call string"


def screened(reads: DataFrame, panel: DataFrame, config: dict) -> DataFrame:
    """(seq_id, seq) and a panel's seeds -> a row per read. The panel is read in place; reads are reduced to their different keys before they move."""
    keys = cut(sketch.seeds(reads, config["k"], config["w"]).select("seq_id", "key").distinct())
    panel_keys = panel.select("key", F.col("seq_id").alias("ref"))
    hits = keys.join(panel_keys, "key").groupBy("seq_id", "key", "ref").agg(F.lit(1).alias("one"))
    shared = hits.groupBy("seq_id", "ref").agg(F.count("*").alias("shared"))
    best = shared.groupBy("seq_id").agg(F.max_by("ref", F.struct("shared", -F.col("ref"))).alias("best_id"), F.max("shared").alias("shared"))
    found = hits.groupBy("seq_id").agg(F.countDistinct("key").alias("n_found"))
    n = keys.groupBy("seq_id").agg(F.count("*").alias("n_keys"))
    every = reads.select("seq_id").distinct().join(n, "seq_id", "left").join(found, "seq_id", "left").join(best, "seq_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    share = F.when(zero(F.col("n_keys")) > 0, F.round(zero(F.col("shared")) / F.col("n_keys"), 6)).otherwise(0.0)
    match = (zero(F.col("shared")) >= config["min_shared"]) & (share >= config["min_share"])
    return every.select(F.col("seq_id").alias("id"), zero(F.col("n_keys")).alias("n_keys"), zero(F.col("n_found")).alias("n_found"), "best_id",
                        zero(F.col("shared")).alias("shared"), share.alias("share"), F.when(match, "match").otherwise("clean").alias("call"))


def run(spark: SparkSession, reads: str, panel: str, target: str, checkpoint: str, config: dict) -> dict:
    """Takes what is new and returns when it is written: {batches, reads, matches} of this run."""
    references = seed_index.seeds(spark, panel)
    new = spark.readStream.schema(f"`{config['id']}` long, `{config['text']}` string").option("maxFilesPerTrigger", config["files_per_batch"]).parquet(reads)
    total = {"batches": 0, "reads": 0, "without_id": 0, "matches": 0}

    def batch(rows: DataFrame, number: int) -> None:
        read = Observation()
        named = rows.select(F.col(config["id"]).alias("seq_id"), bases(config["text"]).alias("seq"))
        named = cut(named.observe(read, F.count("*").alias("reads"), F.count_if(F.col("seq_id").isNull()).alias("without_id"))).filter("seq_id is not null")
        out = screened(named, references, config).withColumn("batch", F.lit(number).cast("long"))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "call").parquet(target)
        wrote = dict(spark.read.schema(OUTPUT).parquet(target).filter(F.col("batch") == number).groupBy("call").count().collect())
        for k, v in {"batches": 1, **read.get, "matches": wrote.get("match", 0)}.items():
            total[k] += v
        log.info("batch %d: read %d reads (%d without an id), wrote %d rows (%d matches) to %s", number, read.get["reads"], read.get["without_id"], sum(wrote.values()), wrote.get("match", 0), target)

    stream = new.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
    log.info("%s: %d new batches, %d reads", reads, total["batches"], total["reads"])
    return total


def output(spark: SparkSession, target: str) -> DataFrame:
    """All reads screened so far."""
    return spark.read.schema(OUTPUT).parquet(target).select("id", "n_keys", "n_found", "best_id", "shared", "share", "call")


if __name__ == "__main__":
    from jobs import command_line

    command_line("read_screen", __doc__.splitlines()[0], ["reads", "panel", "target", "checkpoint"], run)
