"""Exact duplicates by sorting contents.

Texts are range-partitioned by their normalised bytes (Spark samples the splitters), sorted
externally within the ranges so that equal ones are adjacent, and neighbours are compared in full; of equal texts the row with
the smallest identifier stays. Only DataFrame functions run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, cut, text_or_empty


#: Leading characters by which texts are dealt to ranges.
LEAD = 48


def normalised(col: str = "text") -> Column:
    """Each stretch of ASCII white space as one space; null as the empty text."""
    return F.regexp_replace(text_or_empty(col), SPACES, " ")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256 (and the columns, if ``carry``).

    Nulls: a null text equals the empty one; a null id sorts after every other id. Repeated rows
    (equal id and text) are one group, of which exactly one row stays. An empty table gives an empty
    table. Columns of the input called like results are shadowed, with ``carry`` they are replaced.

    Skew: a text with more copies than an average partition has rows is dealt over several sort
    ranges by a salt; the ranges' leaders (a few per such text) are then compared with each other.
    At most ``rows / hot`` texts, under four per partition, can be that frequent, which bounds both
    tables joined by broadcast.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = ["keep_id", "group_size", "kept", "text_sha256"]
    inner = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")] if carry else []
    base = docs.select(F.col(id_col).alias("_id"), normalised(text_col).alias("_norm"), *inner)
    base = base.withColumn("_h", F.xxhash64("_norm"))
    total = docs.count()
    hot = max(16, total // (4 * parts))
    heavy = cut(base.groupBy("_h").agg(F.count("*").alias("_n")).filter(F.col("_n") > hot)
                .select("_h", F.ceil(F.col("_n") / F.lit(hot)).alias("_salts")))
    # at most total / hot < 4 * parts + 1 rows
    base = base.join(F.broadcast(heavy), "_h", "left")
    base = base.withColumn("_salt", F.when(F.col("_salts").isNotNull(), F.pmod(F.xxhash64("_id"), F.col("_salts"))))
    # splitters are sampled from leading bytes, with a hash of the whole for texts that begin alike,
    # so what the sample sends to the driver does not grow with the texts' length
    ranged = base.withColumn("_lead", F.substring("_norm", 1, LEAD)).repartitionByRange(parts, "_lead", "_h", "_salt")
    run = Window.partitionBy("_lead", "_h", "_salt", "_norm")
    first = run.orderBy(F.col("_id").asc_nulls_last())
    marked = ranged.withColumns({
        "_keep": F.first("_id").over(first),
        "_rank": F.row_number().over(first),
        "_size": F.count("*").over(run),
    }).withColumn("_sha", F.sha2(F.col("_norm").cast("binary"), 256)).drop("_norm", "_lead", "_h", "_salts")
    return _joined(marked, id_col, out, carry, docs.columns, heavy.limit(1).count() > 0)


def _joined(marked: DataFrame, id_col: str, out: list[str], carry: bool, columns: list[str], any_hot: bool) -> DataFrame:
    """Leaders of the salted runs of one text agree on the smallest identifier."""
    if any_hot:
        marked = cut(marked)
        leaders = marked.filter("_salt is not null and _rank = 1").select("_sha", "_salt", "_keep", "_size")
        of = leaders.groupBy("_sha").agg(
            F.min("_keep").alias("_all_keep"), F.sum("_size").alias("_all_size"),
            F.min_by("_salt", F.struct(F.col("_keep").isNull(), F.col("_keep"), F.col("_salt"))).alias("_all_salt"))
        marked = marked.join(F.broadcast(of.withColumn("_hot", F.lit(True))), "_sha", "left")
        marked = marked.select(
            *[c for c in ("_id", "_row", "_sha") if c in marked.columns],
            F.when(F.col("_hot"), F.col("_all_keep")).otherwise(F.col("_keep")).alias("_keep"),
            F.when(F.col("_hot"), F.col("_all_size")).otherwise(F.col("_size")).alias("_size"),
            ((F.col("_rank") == 1) & (F.col("_hot").isNull() | (F.col("_salt") == F.col("_all_salt")))).alias("_kept"))
    else:
        marked = marked.withColumn("_kept", F.col("_rank") == 1)
    cols = [F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"), F.col("_kept").alias("kept"), F.col("_sha").alias("text_sha256")]
    if carry:
        return marked.select(*[F.col(f"_row.`{c}`").alias(c) for c in columns if c not in out], *cols)
    return marked.select(F.col("_id").alias(id_col), *cols)


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with exactly the columns they came with."""
    keys = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kept = exact_duplicates(keys, "_id", "_text", carry=True).filter("kept")
    return kept.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
