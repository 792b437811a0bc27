"""Queries that encode, hash and sample sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, seq
from ..operators import metrics, sketch
from . import oracle as O


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sequences(spark: SparkSession, sf_dir: str, name: str = "documents", id_col: str = "doc_id") -> DataFrame:
    return table(spark, sf_dir, name).select(F.col(id_col).alias("seq_id"), seq.bases("text").alias("seq"))


def _bases_stats(s, d):
    b = sequences(s, d)
    count = lambda c: (F.length("seq") - F.length(F.replace(F.col("seq"), F.lit(c), F.lit("")))).cast("long")
    return b.select("seq_id", F.length("seq").cast("long").alias("n_bases"), *[count(c).alias(f"n_{c.lower()}") for c in "ACGT"])


def _segments(s, d):
    return sketch.segments(table(s, d, "documents"), "doc_id", "text")


def _segment_syncmers(s, d):
    runs = sketch.runs_of_bases(table(s, d, "documents"), "doc_id", "text").filter(F.length("seq") >= 4)
    hits = sketch.syncmers(runs.select(F.struct("seq_id", "start").alias("seq_id"), "seq"), 4, 2)
    return hits.select(F.col("seq_id.seq_id").alias("doc_id"), (F.col("seq_id.start") + F.col("pos")).alias("pos"))


def _revcomp(s, d):
    return sequences(s, d).select("seq_id", seq.reverse_complement("seq").alias("rc"))


def _hpc(s, d):
    return sequences(s, d).select("seq_id", seq.homopolymer_compressed("seq").alias("hpc"))


def _slices(s, d):
    b = sequences(s, d)
    n = F.length("seq")
    start = F.floor(n / 4).cast("int")
    return b.select("seq_id", seq.subsequence(F.col("seq"), start, F.least(start + 50, n), F.col("seq_id") % 2 == 1).alias("part"))


def _density(s, d):
    hits = sketch.syncmers(sequences(s, d), 31, 11).groupBy("seq_id").agg(F.count("*").alias("hits"))
    n = F.length("seq").cast("long")
    return sequences(s, d).select("seq_id", n.alias("n_bases")).join(hits, "seq_id").select("seq_id", "n_bases", "hits", F.round(F.col("hits") / F.col("n_bases"), 6).alias("density"))


def _scalar_hashes(s, d):
    """The 32-bit mixer and the masked hash as plain column expressions."""
    x = F.col("event_id").cast("long")
    return table(s, d, "events").select("event_id", hashing.fast_hash(x * 2654435 % 4294967296).alias("h32"), hashing.masked_hash(x * 104729, 15).alias("h30"), hashing.masked_hash(x * 104729, 28).alias("h56"))


def _mixed(s, d):
    k = sketch.sampled_kmers(sequences(s, d), 31, sampler="syncmer", s=11, mixed=True)
    return k.select("seq_id", "pos", F.shiftrightunsigned("kmer", 1).alias("half_hash"), "strand")


def _harvest(s, d):
    return sketch.sampled_kmers(sequences(s, d), 15, 11).select("seq_id", "pos", "kmer", "strand")


def _audit(s, d):
    b = sequences(s, d)
    return metrics.marker_audit(sketch.syncmers(b, 31, 11), b.select("seq_id", F.length("seq").cast("long").alias("length")), 31)


def _totals(s, d):
    b = sequences(s, d)
    return metrics.scan_totals(sketch.syncmers(b, 31, 11, t=5, closed=False), b.select("seq_id", F.length("seq").cast("long").alias("length")))


def _block_compat(s, d):
    return sketch.minimizers(sequences(s, d), 15, 11, block_compat=True)


def _mutated(s, d):
    b = sequences(s, d)
    m = b.select("seq_id", seq.point_mutated(F.col("seq"), F.col("seq_id"), 20).alias("seq"))
    return metrics.set_comparison(sketch.minimizers(b, 21, 11), sketch.minimizers(m, 21, 11), ["seq_id", "pos", "hash"])


def _shared(s, d):
    a = sketch.minimizers(sequences(s, d), 15, 11)
    b = sketch.minimizers(sequences(s, d, "benchmark", "item_id"), 15, 11)
    return metrics.set_comparison(a, b, ["hash"])


QUERIES = {
    "seq_sketch_density": _density,
    "seq_bases_stats": _bases_stats,
    "seq_segments": _segments,
    "seq_revcomp": _revcomp,
    "seq_hpc": _hpc,
    "seq_slices": _slices,
    "hash_functions": _scalar_hashes,
    "hash32_digest": lambda s, d: sketch.smer_hashes(sequences(s, d), 11),
    "minimizers": lambda s, d: sketch.minimizers(sequences(s, d), 15, 11),
    "minimizers_long": lambda s, d: sketch.minimizers(sequences(s, d), 31, 21),
    "minimizers_fwd": lambda s, d: sketch.minimizers(sequences(s, d), 15, 31, canonical=False),
    "syncmers_closed": lambda s, d: sketch.syncmers(sequences(s, d), 31, 11),
    "syncmers_closed_short": lambda s, d: sketch.syncmers(sequences(s, d), 15, 5),
    "syncmers_open": lambda s, d: sketch.syncmers(sequences(s, d), 31, 11, t=10, closed=False),
    "syncmers_open_strict": lambda s, d: sketch.syncmers(sequences(s, d), 31, 11, closed=False, strict=True),
    "syncmers_fwd": lambda s, d: sketch.syncmers(sequences(s, d), 21, 11, canonical=False),
    "segment_syncmers": _segment_syncmers,
    "harvest_kmers": _harvest,
    "mix64_keys": _mixed,
    "marker_audit": _audit,
    "scan_totals": _totals,
    "minimizers_block_compat": _block_compat,
    "snp_conservation": _mutated,
    "sketch_jaccard": _shared,
}

_B = O.seqs()
_COMPARE = """, x AS (SELECT DISTINCT {on} FROM {a}), y AS (SELECT DISTINCT {on} FROM {b}),
 c AS (SELECT (SELECT count(*) FROM x) AS size_a, (SELECT count(*) FROM y) AS size_b, (SELECT count(*) FROM (SELECT * FROM x INTERSECT SELECT * FROM y)) AS common)
 SELECT size_a, size_b, common, round(common / (size_a + size_b - common), 6) AS jaccard, round(common / size_a, 6) AS conserved FROM c"""
_MUTATED = """m AS (SELECT seq_id, array_to_string(list_transform(range(0, length(seq)), lambda i:
  CASE WHEN ((i*7919 + seq_id*104729) % 1000003) % 20 = 0 THEN translate(substr(seq, i+1, 1), 'ACGT', 'CATG') ELSE substr(seq, i+1, 1) END), '') AS seq FROM b)"""
_RUNS = """t AS (SELECT doc_id AS seq_id, unnest(regexp_extract_all(coalesce(text,''), '[ACGTacgt]+|[^ACGTacgt]+')) AS run, generate_subscripts(regexp_extract_all(coalesce(text,''), '[ACGTacgt]+|[^ACGTacgt]+'), 1) AS i FROM documents),
 sg AS (SELECT seq_id, run, CAST(coalesce(sum(length(run)) OVER (PARTITION BY seq_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS file_offset, CAST(length(run) AS BIGINT) AS logical_len,
   CASE WHEN regexp_matches(run, '^[ACGTacgt]') THEN 'BASES' ELSE 'N_GAP' END AS type FROM t)"""


def _sync(**o):
    return f"WITH {_B}, {O.syncmers('s', 'b', **o)} SELECT seq_id, pos FROM s"


ORACLES = {
    "seq_sketch_density": f"WITH {_B}, {O.syncmers('s', 'b', 31, 11)} SELECT b.seq_id, CAST(length(seq) AS BIGINT) AS n_bases, count(*) AS hits, round(count(*) / length(seq), 6) AS density FROM b JOIN s USING (seq_id) GROUP BY b.seq_id, seq",
    "seq_bases_stats": f"WITH {_B} SELECT seq_id, CAST(length(seq) AS BIGINT) AS n_bases, " + ", ".join(f"CAST(length(seq) - length(replace(seq, '{c}', '')) AS BIGINT) AS n_{c.lower()}" for c in "ACGT") + " FROM b",
    "seq_segments": f"WITH {_RUNS} SELECT seq_id, file_offset, logical_len, type FROM sg",
    "seq_revcomp": f"WITH {_B} SELECT seq_id, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc FROM b",
    "seq_hpc": f"WITH {_B} SELECT seq_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(seq,'A+','A','g'),'C+','C','g'),'G+','G','g'),'T+','T','g') AS hpc FROM b",
    "seq_slices": f"WITH {_B}, c AS (SELECT seq_id, substr(seq, length(seq)//4 + 1, least(50, length(seq) - length(seq)//4)) AS p FROM b) SELECT seq_id, CASE WHEN seq_id % 2 = 1 THEN reverse(translate(p, 'ACGT', 'TGCA')) ELSE p END AS part FROM c",
    "hash_functions": "WITH e AS (SELECT event_id, CAST(event_id AS BIGINT)*2654435 % 4294967296 AS f, CAST(event_id AS BIGINT)*104729 AS c FROM events), "
    "e1 AS (SELECT event_id AS seq_id, 0 AS len, event_id AS pos, f, f AS r FROM e), " + O.hashes("h", "e1") + ", " + O.masked_hash("k15", "e", "c", 15, "event_id") + ", " + O.masked_hash("k28", "e", "c", 28, "event_id")
    + " SELECT h.pos AS event_id, h.h AS h32, k15.key AS h30, k28.key AS h56 FROM h JOIN k15 ON h.pos = k15.event_id JOIN k28 ON h.pos = k28.event_id",
    "hash32_digest": f"WITH {_B}, {O.kmers('k', 'b', 11)}, {O.hashes('h', 'k')}, g AS (SELECT seq_id, count(*) AS n, bit_xor(h) AS digest FROM h GROUP BY seq_id) SELECT b.seq_id, coalesce(n, 0) AS n, coalesce(digest, 0) AS digest FROM b LEFT JOIN g USING (seq_id)",
    "minimizers": f"WITH {_B}, {O.minimizers('m', 'b', 15, 11)} SELECT seq_id, pos, hash FROM m",
    "minimizers_long": f"WITH {_B}, {O.minimizers('m', 'b', 31, 21)} SELECT seq_id, pos, hash FROM m",
    "minimizers_fwd": f"WITH {_B}, {O.minimizers('m', 'b', 15, 31, False)} SELECT seq_id, pos, hash FROM m",
    "syncmers_closed": _sync(k=31, s=11),
    "syncmers_closed_short": _sync(k=15, s=5),
    "syncmers_open": _sync(k=31, s=11, t=10, closed=False),
    "syncmers_open_strict": _sync(k=31, s=11, strict=True),
    "syncmers_fwd": _sync(k=21, s=11, canonical=False),
    "segment_syncmers": f"WITH {_RUNS}, b AS (SELECT {{'doc': seq_id, 'start': file_offset}} AS seq_id, upper(run) AS seq FROM sg WHERE type = 'BASES'), {O.syncmers('s', 'b', 4, 2)} SELECT seq_id.doc AS doc_id, seq_id.start + pos AS pos FROM s",
    "harvest_kmers": f"WITH {_B}, {O.minimizers('m', 'b', 15, 11)} SELECT m.seq_id, m.pos, least(f, r) AS kmer, CAST(r < f AS INT) AS strand FROM m JOIN m_k k ON m.seq_id = k.seq_id AND m.pos = k.pos",
    "mix64_keys": f"WITH {_B}, {O.syncmers('s', 'b', 31, 11)}, j AS (SELECT s.seq_id, s.pos, b.seq FROM s JOIN b USING (seq_id)), c AS (SELECT seq_id, pos, {O.le_code(31)} AS f, {O.le_reverse(31)} AS r FROM j), "
    "x1 AS (SELECT seq_id, pos, CAST(r < f AS INT) AS strand, xor(least(f, r), least(f, r) >> 33) AS x FROM c), x2 AS (SELECT seq_id, pos, strand, CAST((CAST(x AS UHUGEINT)*18397679294719823053::UHUGEINT) % 18446744073709551616::UHUGEINT AS UBIGINT) AS x FROM x1) "
    "SELECT seq_id, pos, CAST(xor(x, x >> 33) >> 1 AS BIGINT) AS half_hash, strand FROM x2",
    "marker_audit": f"WITH {_B}, {O.syncmers('s', 'b', 31, 11)}, g AS (SELECT s.seq_id, s.pos, length(b.seq) AS len, s.pos - lag(s.pos) OVER (PARTITION BY s.seq_id ORDER BY s.pos) AS gap FROM s JOIN b USING (seq_id)) "
    "SELECT seq_id, count(*) AS hits, CAST(count(*) FILTER (pos + 31 > len) AS BIGINT) AS out_of_bounds, CAST(count(*) FILTER (gap < 31) AS BIGINT) AS close, CAST(sum(least(coalesce(gap, 31), 31)) AS BIGINT) AS covered, round(sum(least(coalesce(gap, 31), 31)) / len, 6) AS coverage FROM g GROUP BY seq_id, len",
    "scan_totals": f"WITH {_B}, {O.syncmers('s', 'b', 31, 11, t=5, closed=False)}, n AS (SELECT count(*) AS sequences, CAST(sum(length(seq)) AS BIGINT) AS bases FROM b), h AS (SELECT count(*) AS hits, coalesce(bit_xor((seq_id*1000003 + pos) % 2147483647), 0) AS digest FROM s) SELECT sequences, bases, hits, round(hits/bases, 6) AS density, digest FROM n, h",
    "minimizers_block_compat": f"WITH {_B}, {O.minimizers('m', 'b', 15, 11)} SELECT DISTINCT seq_id, m & 4294967295 AS pos, (m >> 32)*256 AS hash FROM m_m WHERE pos + 25 <= len AND pos < greatest(0, (len + 127)//128 - 1)*128",
    "snp_conservation": f"WITH {_B}, {_MUTATED}, {O.minimizers('p', 'b', 21, 11)}, {O.minimizers('q', 'm', 21, 11)}" + _COMPARE.format(on="seq_id, pos, hash", a="p", b="q"),
    "sketch_jaccard": f"WITH {_B}, {O.seqs('i', 'benchmark', 'item_id')}, {O.minimizers('p', 'b', 15, 11)}, {O.minimizers('q', 'i', 15, 11)}" + _COMPARE.format(on="hash", a="p", b="q"),
}
