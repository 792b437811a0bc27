"""Incremental sketching: chunks of sequences come as a stream, hits go out as soon as they are certain.

State per sequence: the bases that later windows still need, where they begin, the last minimizer,
and chunks that came before their predecessors. A hit is emitted once, whatever the chunks' sizes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import kernels as K
from ..runtime import ship

_STATE = "begin long, tail string, last long, waiting_at array<long>, waiting array<string>"


def _codes(seq: str) -> tuple[np.ndarray, np.ndarray]:
    c = K._CODE[np.frombuffer(seq.encode(), np.uint8)]
    return c, np.array([0, len(c)])


def advance(state: tuple, chunks: list[tuple[int, str]], kind: str, k: int, w: int, s: int) -> tuple[tuple, list[tuple[int, int]]]:
    """(state, (offset, bases) chunks in any order) -> new state and certain hits (place, hash)."""
    begin, tail, last, waiting = state
    waiting = {**waiting, **{o: c for o, c in chunks if o + len(c) > begin + len(tail)}}
    grown = False
    while True:
        end = begin + len(tail)
        ready = [o for o in waiting if o <= end]
        if not ready:
            break
        for o in ready:
            c = waiting.pop(o)
            if o + len(c) > begin + len(tail):
                tail += c[begin + len(tail) - o :]
                grown = True
    if not grown:
        return (begin, tail, last, waiting), []
    codes, off = _codes(tail)
    span = k + w - 1 if kind == "minimizer" else k
    if kind == "minimizer":
        at, h = K.minimizer_places(codes, off, k, w)
        hits = [(begin + int(a), int(x)) for a, x in zip(at, h) if begin + int(a) > last]
        last = max([last, *(p for p, _ in hits)])
    else:
        hits = [(begin + int(a), 0) for a in K.syncmer_places(codes, off, k, s)]
    done = max(0, len(tail) - span + 1)  # windows that began are complete
    return (begin + done, tail[done:], last, waiting), hits


def sketch_stream(chunks: DataFrame, kind: str = "minimizer", k: int = 15, w: int = 11, s: int = 11) -> DataFrame:
    """(seq_id, offset, chunk) stream -> (seq_id, pos, hash) stream, in append mode."""
    ship(chunks.sparkSession)

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            begin, tail, last, at, held = state.get
            now = begin, tail, last, dict(zip(at, held))
        else:
            now = 0, "", -1, {}
        for pdf in pdfs:
            pdf = pdf.sort_values("offset")
            now, hits = advance(now, list(zip(pdf["offset"].tolist(), pdf["chunk"].tolist())), kind, k, w, s)
            if hits:
                yield pd.DataFrame({"seq_id": key[0], "pos": [p for p, _ in hits], "hash": [h for _, h in hits]})
        begin, tail, last, waiting = now
        state.update((begin, tail, last, list(waiting), list(waiting.values())))

    return chunks.groupBy("seq_id").applyInPandasWithState(step, "seq_id long, pos long, hash long", _STATE, "append", GroupStateTimeout.NoTimeout)


def sketch_files(spark, path: str, files_per_trigger: int = 16, **options) -> DataFrame:
    """Parquet files of (seq_id, offset, chunk) as they arrive, a bounded number at a time."""
    raw = spark.readStream.schema("seq_id long, offset long, chunk string").option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return sketch_stream(raw, **options)
