"""Reads made by a rule, for trials at any size: every row comes from its number, so tasks need not talk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def reads(spark: SparkSession, n: int, length: int = 150, seed: int = 42) -> DataFrame:
    """(rid, name, comment, seq, qual): pseudo-random bases by a hash of seed, read and place."""
    base = F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: F.element_at(F.array(*[F.lit(c) for c in "ACGT"]), (F.pmod(F.xxhash64(F.col("id"), i, F.lit(seed)), F.lit(4)) + 1).cast("int")))
    return spark.range(n).select(F.col("id").alias("rid"), F.concat(F.lit("read"), F.col("id").cast("string")).alias("name"), F.lit("").alias("comment"), F.array_join(base, "").alias("seq"), F.repeat(F.lit("I"), length).alias("qual"))


def fastq_lines(records: DataFrame, mixed_ends: bool = False, marked_in: int = 0) -> DataFrame:
    """(value): four lines a record as one, for ``write.text``. With ``mixed_ends`` every other record ends its lines with
    a carriage return too; about one in ``marked_in`` begins with a byte order mark."""
    end = F.when(F.lit(mixed_ends) & (F.col("rid") % 2 == 1), "\r\n").otherwise("\n")
    mark = F.when(F.lit(marked_in > 0) & (F.pmod(F.xxhash64("rid"), F.lit(max(marked_in, 1))) == 0), chr(0xFEFF)).otherwise("")
    last = F.when(F.lit(mixed_ends) & (F.col("rid") % 2 == 1), "\r").otherwise("")
    return records.select(F.concat(mark, F.lit("@"), "name", end, "seq", end, F.lit("+"), end, "qual", last).alias("value"))
