"""Queries that summarise measurements, on the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import seq
from ..operators import metrics
from .sketch_queries import table


def _events(s, d):
    return table(s, d, "events").select("event_type", (F.pow(F.lit(2), F.col("user_id") % 4)).cast("int").alias("threads"), F.col("event_type").alias("tool"), (F.col("value") + 100.0).alias("value"))


def _tolerance(s, d):
    m = _events(s, d).groupBy("tool").agg(F.round(F.avg("value"), 6).alias("value")).withColumn("expected", F.lit(140.0)).select(F.col("tool").alias("name"), "expected", "value")
    return metrics.tolerance(m, 2.0, 8.0)


def _texts(s, d):
    e = table(s, d, "events").select("event_id")
    n = F.col("event_id")
    t = F.concat((n % 97).cast("string"), F.element_at(F.array(F.lit("k"), F.lit("M"), F.lit("G"), F.lit("")), (n % 4 + 1).cast("int")))
    name = F.concat(F.lit("read"), n.cast("string"), F.when(n % 3 == 0, "/1").when(n % 3 == 1, "/2").otherwise(""))
    return e.select("event_id", seq.number_with_suffix(t).alias("number"), seq.fragment_name(name).alias("fragment"), seq.io_bytes((n % 50).cast("double") / 7).alias("bytes"),
                    seq.sequence_name(F.concat(name, F.lit(" a comment"))).alias("name"), seq.escaped(F.concat(F.lit("a\\tb\\\\"), name)).alias("unescaped"))


QUERIES = {
    "metrics_summary": lambda s, d: metrics.scaling(_events(s, d)),
    "metrics_tolerance": _tolerance,
    "metrics_grid": lambda s, d: metrics.grid_summary(_events(s, d), "tool", "threads"),
    "scalar_texts": _texts,
}

_E = "e AS (SELECT event_type AS tool, CAST(pow(2, user_id % 4) AS INT) AS threads, value + 100.0::DOUBLE AS value FROM events)"
ORACLES = {
    "metrics_summary": f"WITH {_E}, m AS (SELECT tool, threads, count(*) AS n, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS std FROM e GROUP BY ALL), o AS (SELECT tool, mean AS single FROM m WHERE threads = 1) "
    "SELECT m.tool, threads, n, round(mean, 6) AS mean, round(std, 6) AS std, round(mean/single, 6) AS speedup, round(mean/(threads*single), 6) AS efficiency FROM m LEFT JOIN o ON m.tool = o.tool",
    "metrics_tolerance": f"WITH {_E}, m AS (SELECT tool AS name, 140.0::DOUBLE AS expected, round(avg(value), 6) AS value FROM e GROUP BY tool), d AS (SELECT *, 100*abs(value-expected)/abs(expected) AS d FROM m) "
    "SELECT name, expected, value, round(d, 6) AS deviation, CASE WHEN d <= 2 THEN 'ok' WHEN d <= 8 THEN 'warn' ELSE 'fail' END AS status FROM d",
    "metrics_grid": f"WITH {_E} SELECT tool, threads, count(*) AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std FROM e GROUP BY ALL",
    "scalar_texts": r"WITH e AS (SELECT event_id AS n, 'read' || event_id || CASE event_id % 3 WHEN 0 THEN '/1' WHEN 1 THEN '/2' ELSE '' END AS nm FROM events) "
    r"SELECT n AS event_id, CAST(floor((n % 97) * CASE n % 4 WHEN 0 THEN 1e3 WHEN 1 THEN 1e6 WHEN 2 THEN 1e9 ELSE 1.0 END + 0.499) AS BIGINT) AS number, regexp_replace(nm, '/[0-9]$', '') AS fragment, "
    r"CAST(ceil(greatest(round((n % 50)/7.0::DOUBLE*1048576), 4096.0)/4096)*4096 AS BIGINT) AS bytes, nm AS name, 'a' || chr(9) || 'b' || chr(92) || nm AS unescaped FROM e",
}
