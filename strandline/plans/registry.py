"""All queries over the driver's tables, and their SQL twins."""

from __future__ import annotations

from . import index_queries, interval_queries, kernel_queries, metric_queries, sketch_queries

_PARTS = (sketch_queries, index_queries, interval_queries, metric_queries, kernel_queries)
QUERIES = {k: q for p in _PARTS for k, q in p.QUERIES.items()}
ORACLES = {k: q for p in _PARTS for k, q in p.ORACLES.items()}
