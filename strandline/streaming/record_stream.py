"""Records of files that come as a stream of chunks: the parser's state is carried from chunk to chunk.

State per file: how far it was read, the text behind the last whole record, and chunks that came before
their predecessors. A record goes out as soon as the next one begins, the last one with the end mark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..runtime import ship

_STATE = "done long, given long, rest string, waiting_at array<long>, waiting array<string>, ends array<boolean>"
RECORD = "file string, n long, name string, comment string, seq string, qual string"


def parsed(rest: str, kind: str, last: bool) -> tuple[list[tuple[str, str, str, str | None]], str]:
    """Whole records of a text that begins at a record, and what is left of it."""
    out: list[tuple[str, str, str, str | None]] = []

    def add(header: str, seq: str, qual: str | None):
        name, _, comment = header.lstrip("﻿").strip().partition(" ")
        out.append((name, comment.strip(), seq.translate(str.maketrans("Uu", "Tt")), qual))

    if kind == "fastq":
        lines = rest.split("\n")
        whole = lines if last else lines[:-1]
        n = len(whole) // 4 * 4
        if last and len(whole) - n >= 2 and any(whole[n:]):  # a last record without its end
            whole = [*whole, *[""] * (4 - (len(whole) - n))]
            n += 4
        for i in range(0, n, 4):
            h, s, _, q = (x.replace("\r", "").replace("﻿", "") for x in whole[i : i + 4])
            if h or s:
                add(h.removeprefix("@"), s, q)
        return out, "" if last else "\n".join([*whole[n:], lines[-1]])
    parts = rest.split(">")
    whole, left = (parts, "") if last else (parts[:-1], parts[-1])
    for k, p in enumerate(whole):
        if p.strip():
            head, _, body = p.replace("\r", "").partition("\n")
            add(head, body.replace("\n", ""), None)
    return out, left


def advance(state: tuple, chunks: list[tuple[int, str, bool]], kind: str) -> tuple[tuple, list]:
    """(state, (offset, text, is the file's end) in any order) -> new state and the records that are whole now."""
    done, given, rest, waiting = state
    waiting = {**waiting, **{o: (t, e) for o, t, e in chunks if o >= done}}
    out = []
    while done in waiting:
        text, last = waiting.pop(done)
        done += len(text)
        got, rest = parsed(rest + text, kind, last)
        out += [(given + i, *r) for i, r in enumerate(got)]
        given += len(got)
        if last:
            break
    return (done, given, rest, waiting), out


def record_stream(chunks: DataFrame, kind: str = "fasta") -> DataFrame:
    """(file, offset, chunk, last) stream, offsets in characters -> (file, n, name, comment, seq, qual) stream, in append mode."""
    ship(chunks.sparkSession)

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            done, given, rest, at, texts, ends = state.get
            now = (done, given, rest, {o: (t, bool(e)) for o, t, e in zip(at, texts, ends)})
        else:
            now = (0, 0, "", {})
        rows = [(int(o), c, bool(e)) for p in pdfs for o, c, e in zip(p["offset"], p["chunk"], p["last"])]
        (done, given, rest, waiting), out = advance(now, rows, kind)
        order = sorted(waiting)
        state.update((done, given, rest, order, [waiting[o][0] for o in order], [waiting[o][1] for o in order]))
        yield pd.DataFrame([(key[0], *r) for r in out], columns=["file", "n", "name", "comment", "seq", "qual"])

    return chunks.groupBy("file").applyInPandasWithState(step, RECORD, _STATE, "append", GroupStateTimeout.NoTimeout)
