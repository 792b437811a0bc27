"""A corpus pipeline: quality, exact copies, near copies, source mix, packing.

Each stage takes whole rows and returns the rows it keeps with the columns they came with, whatever these
are called; the last one returns pieces. Null texts are empty, null ids stay null, repeated rows are rows
of their own, and a table without rows gives one without rows; what each stage does with them:
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import exact_dedup, minhash, mixing, packing, quality
from strandline.llm.common import cut


def sound(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier grades sound and clean; the others go, and so do texts without a word."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").withColumn("grade", quality.grade())
    return quality.selected(docs, quality.train(docs, labels))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the smallest doc_id stays (null ids last; of equal ids one row)."""
    return exact_dedup.without_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked near copies, the document with the smallest doc_id stays; rows with a null id stay."""
    return minhash.without_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, the last one of a source in part; a null source is one more source."""
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences; an empty text is its closing token."""
    return packing.pack(docs)


STAGES = [("quality classifier", sound), ("exact dedup", exact), ("minhash near-dedup", near), ("source mix", mix), ("packing", packed)]

#: Near-duplicate components, tokenisation and packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder, each written and read again before the next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs
