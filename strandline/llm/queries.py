"""One query per corpus operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, exact_dedup, fim, html, licenses, lm, minhash, mixing, packing, pii, quality


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licenses": lambda s, d: licenses.scan(table(s, d, "documents")),
    "op2_ann": lambda s, d: ann.query(table(s, d, "embeddings")),
    "op3_mixing": lambda s, d: mixing.query(table(s, d, "documents")),
    "op4_minhash": lambda s, d: minhash.near_duplicates(table(s, d, "documents")),
    "op5_html": lambda s, d: html.extract(table(s, d, "pages")),
    "op6_packing": lambda s, d: packing.pack(table(s, d, "documents")),
    "op7_quality": lambda s, d: quality.query(table(s, d, "documents"), table(s, d, "labels")),
    "op8_exact_dedup": lambda s, d: exact_dedup.exact_duplicates(table(s, d, "documents").select("doc_id", "text")),
    "op9_pii": lambda s, d: pii.query(table(s, d, "documents")),
    "op10_lm": lambda s, d: lm.query(table(s, d, "documents")),
    "op11_fim": lambda s, d: fim.query(table(s, d, "documents")),
    "op12_bpe": lambda s, d: bpe.query(table(s, d, "documents")),
}

ORACLES: dict[str, str] = {
    "op3_mixing": mixing.ORACLE,
    "op11_fim": fim.ORACLE,
    "op8_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, CAST(count(*) OVER (PARTITION BY t) AS BIGINT) AS group_size,
               row_number() OVER w = 1 AS kept, sha256(t) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY t ORDER BY doc_id NULLS LAST)""",
}


def oracles() -> dict[str, str]:
    """All of them; the one for licences holds trained weights, so it is made when asked for."""
    return {"op1_licenses": licenses.oracle(), **ORACLES}
