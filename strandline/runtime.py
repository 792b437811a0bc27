"""Python code on executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="strandline-code-"), "strandline_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for d, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(d, n)
                    z.write(full, os.path.join("strandline", os.path.relpath(full, root)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def tasks(spark: SparkSession) -> int:
    """As many as the session has shuffle partitions, for rows that are few bytes but much work."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def map_arrow(df: DataFrame, kernel, schema: str) -> DataFrame:
    """mapInArrow with this package at hand."""
    ship(df.sparkSession)
    return df.mapInArrow(kernel, schema)


_own_dir: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one of our own only in local mode."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d
    app = spark.sparkContext.applicationId
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if app not in _own_dir:
        _own_dir[app] = "file://" + tempfile.mkdtemp(prefix="strandline-")
    return _own_dir[app]


def scratch_path(spark: SparkSession) -> str:
    """A new name in the shared folder; what is written there goes when the application ends."""
    path = f"{scratch_dir(spark).rstrip('/')}/strandline-{uuid.uuid4().hex}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write a table into the shared folder and read it again: it is computed once, and lost executors cost nothing
    afterwards."""
    path = scratch_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
