"""The operators under names of SQL: scalar functions that Spark inlines, and table functions over Arrow batches."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..runtime import ship
from .seq import IUPAC, IUPAC_COMPLEMENT

#: Scalar functions: arguments, type and body; all of them are plain SQL, so plans hold no Python.
SCALARS: dict[str, tuple[str, str, str]] = {
    "seq_bases": ("text STRING", "STRING", "upper(regexp_replace(coalesce(text, ''), '[^ACGTacgt]', ''))"),
    "seq_revcomp": ("seq STRING", "STRING", f"reverse(translate(seq, '{IUPAC}', '{IUPAC_COMPLEMENT}'))"),
    "seq_slice": ("seq STRING, start INT, stop INT, turned BOOLEAN", "STRING", f"CASE WHEN turned THEN reverse(translate(substring(seq, start + 1, stop - start), '{IUPAC}', '{IUPAC_COMPLEMENT}')) ELSE substring(seq, start + 1, stop - start) END"),
    "seq_hpc": ("seq STRING", "STRING", "regexp_replace(regexp_replace(regexp_replace(regexp_replace(seq, 'A+', 'A'), 'C+', 'C'), 'G+', 'G'), 'T+', 'T')"),
    "seq_name": ("header STRING", "STRING", "split(header, '[\\\\x00-\\\\x20]')[0]"),
    "seq_fragment": ("name STRING", "STRING", "regexp_replace(name, '/[0-9]$', '')"),
    "seq_hash32": ("x BIGINT", "BIGINT", "{h}"),
}
_MIX = "(x ^ shiftright(x, 13))"
_TIMES = f"((({_MIX} * 51819L) + ((({_MIX} * 34283L) & 65535L) * 65536L)) & 4294967295L)"
SCALARS["seq_hash32"] = ("x BIGINT", "BIGINT", f"{_TIMES} ^ shiftright({_TIMES}, 16)")


class Minimizers:
    """(pos, hash) of a sequence's minimizers."""

    def eval(self, seq: str, k: int, w: int):
        codes, off = _codes(seq)
        from strandline.functions import kernels as K

        at, h = K.minimizer_places(codes, off, k, w)
        yield from zip(at.tolist(), h.astype("int64").tolist())


class Syncmers:
    """pos of a sequence's closed syncmers."""

    def eval(self, seq: str, k: int, s: int):
        codes, off = _codes(seq)
        from strandline.functions import kernels as K

        for p in K.syncmer_places(codes, off, k, s).tolist():
            yield (p,)


def _codes(seq: str):
    import pyarrow as pa

    from strandline.functions import kernels as K

    return K.sequences(pa.array([seq or ""]))


TABLES = {"seq_minimizers": (Minimizers, "pos bigint, hash bigint"), "seq_syncmers": (Syncmers, "pos bigint")}


def register(spark: SparkSession) -> list[str]:
    """Make all functions known to ``spark.sql``; their names.

    Table functions take a sequence and two numbers: ``FROM t, LATERAL seq_syncmers(t.seq, 31, 11)``.
    """
    from pyspark.sql.functions import udtf

    ship(spark)
    for name, (args, kind, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    for name, (table, schema) in TABLES.items():
        spark.udtf.register(name, udtf(table, returnType=schema))
    return [*SCALARS, *TABLES]
