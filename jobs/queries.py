"""The jobs as queries: each runs twice into a new folder, whose files stay, and returns what lies there after the second run."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from jobs import read_screen, seed_index, settings
from strandline.plans import oracle as O
from strandline.runtime import scratch_dir

HERE = "file://" + os.path.dirname(os.path.abspath(__file__))


def _folder(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _seed_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, config = _folder(spark, "seed-index"), settings(spark, f"{HERE}/seed_index.json")
    for _ in range(2):
        seed_index.run(spark, f"{sf_dir}/documents.parquet", target, config)
    return seed_index.output(spark, target).fillna(-1)  # of frequent keys: no occurrences are kept


def _read_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "read-screen")
    panel, config = {**settings(spark, f"{HERE}/seed_index.json"), "id": "item_id"}, settings(spark, f"{HERE}/read_screen.json")
    seed_index.run(spark, f"{sf_dir}/benchmark.parquet", f"{folder}/panel", panel)
    for _ in range(2):  # as a pattern, the table may be a file or a folder
        read_screen.run(spark, f"{sf_dir}/documents.parque[t]", f"{folder}/panel", f"{folder}/out", f"{folder}/checkpoint", config)
    return read_screen.output(spark, f"{folder}/out").fillna(-1)  # no reference


QUERIES = {"job1_seed_index": _seed_index, "job2_read_screen": _read_screen}

K, W = 15, 11
_CAP = ("n{0} AS (SELECT key, count(*) AS n, count(DISTINCT seq_id) AS n_seqs FROM {0} GROUP BY key), k{0} AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS k, count(*) OVER () AS c FROM n{0}), "
        "c{0} AS (SELECT coalesce(max(greatest(10, least(1000000, n + 1))), 1000000) AS cap FROM k{0} WHERE k = CAST(floor((1 - 0.0002::DOUBLE)*c) AS BIGINT))")
ORACLES = {
    "job1_seed_index": f"WITH {O.seqs()}, {O.seeds('t', 'b', K, W)}, {_CAP.format('t')}, "
    "p AS (SELECT key, min(seq_id) AS first_id, max(seq_id) AS last_id, CAST(sum(pos) AS BIGINT) AS pos_sum, CAST(sum(strand) AS BIGINT) AS reverse FROM t GROUP BY key), "
    "f AS (SELECT key, n, n_seqs, n > (SELECT cap FROM ct) AS frequent FROM nt) "
    "SELECT key, n, n_seqs, frequent, CASE WHEN frequent THEN -1 ELSE first_id END AS first_id, CASE WHEN frequent THEN -1 ELSE last_id END AS last_id, CASE WHEN frequent THEN -1 ELSE pos_sum END AS pos_sum, CASE WHEN frequent THEN -1 ELSE reverse END AS reverse FROM f JOIN p USING (key)",
    "job2_read_screen": f"WITH {O.seqs()}, {O.seqs('i', 'benchmark', 'item_id')}, {O.seeds('q', 'b', K, W)}, {O.seeds('t', 'i', K, W)}, {_CAP.format('t')}, "
    "panel AS (SELECT DISTINCT t.key, t.seq_id AS ref FROM t JOIN nt USING (key) WHERE n <= (SELECT cap FROM ct)), reads AS (SELECT DISTINCT seq_id, key FROM q), "
    "s AS (SELECT seq_id, ref, count(*) AS shared FROM reads JOIN panel USING (key) GROUP BY seq_id, ref), best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY seq_id ORDER BY shared DESC, ref) = 1), "
    "n AS (SELECT seq_id, count(*) AS n_keys, count(*) FILTER (key IN (SELECT key FROM panel)) AS n_found FROM reads GROUP BY seq_id), "
    "o AS (SELECT b.seq_id AS id, coalesce(n_keys, 0) AS n_keys, coalesce(n_found, 0) AS n_found, coalesce(ref, -1) AS best_id, coalesce(shared, 0) AS shared, coalesce(round(shared/n_keys, 6), 0.0)::DOUBLE AS share FROM b LEFT JOIN n USING (seq_id) LEFT JOIN best USING (seq_id)) "
    "SELECT *, CASE WHEN shared >= 2 AND share >= 0.05::DOUBLE THEN 'match' ELSE 'clean' END AS call FROM o",
}
