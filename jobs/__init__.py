"""Runnable jobs; each works in a session that it is given, only the command line makes and stops one."""

from __future__ import annotations

import argparse
import json
import logging
import os

from pyspark.sql import SparkSession


def settings(spark: SparkSession, path: str) -> dict:
    """A config file, which may be remote."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def command_line(name: str, doc: str, paths: list[str], run) -> None:
    """``name PATH... [--config FILE]``: makes a session, runs the job, stops the session."""
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    p = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=doc)
    for x in paths:
        p.add_argument(x)
    p.add_argument("--config", default="file://" + os.path.join(os.path.dirname(os.path.abspath(__file__)), f"{name}.json"))
    a = p.parse_args()
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        run(spark, *[getattr(a, x) for x in paths], settings(spark, a.config))
    finally:
        spark.stop()
