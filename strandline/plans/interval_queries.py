"""Queries on introns, junctions, splice scores, contig lists and masked stretches.

The driver has no such tables; they are made of ``orders`` and ``lineitem`` by whole-number rules
that both engines state alike: a contig is a customer's nation, positions come from the keys.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import index, intervals, seeding, sketch
from .sketch_queries import sequences, table


def _introns(s, d):
    """(chrom, st, en, score, strand) with repeats."""
    o = table(s, d, "orders")
    k = F.col("o_orderkey").cast("long")
    st = (k % 4999) * 37
    return o.select(F.concat(F.lit("chr"), (k % 23).cast("string")).alias("chrom"), st.alias("st"), (st + 100 + (k % 7) * 50).alias("en"), (k % 1000).cast("int").alias("score"), F.when(k % 2 == 0, "+").otherwise("-").alias("strand"))


def _regions(s, d):
    c = table(s, d, "customer")
    k = F.col("c_custkey").cast("long")
    st = (k * 7919) % 180000
    return c.select(k.alias("region_id"), F.concat(F.lit("chr"), (k % 23).cast("string")).alias("chrom"), st.alias("st"), (st + 1500).alias("en"))


def _scores(s, d):
    o = table(s, d, "orders")
    k = F.col("o_orderkey").cast("long")
    raw = o.select(F.concat(F.lit("chr"), (k % 29).cast("string")).alias("chrom"), ((k * 131) % 200000).alias("pos"), F.when(k % 3 == 0, "+").otherwise("-").alias("strand"), F.when(k % 2 == 0, "D").otherwise("A").alias("type"), (k % 201 - 100).cast("double").alias("score"))
    refs = s.range(23).select(F.concat(F.lit("chr"), F.col("id").cast("string")).alias("name"), F.col("id").alias("rid"), F.lit(190000).alias("len"))
    return raw, refs


def _bed12(s, d):
    o = table(s, d, "orders")
    k = F.col("o_orderkey").cast("long")
    bed = o.select(F.concat(F.lit("chr"), (k % 23).cast("string")).alias("chrom"), ((k % 997) * 10).alias("start"), (k % 1000).alias("score"), F.when(k % 2 == 0, "+").otherwise("-").alias("strand"),
                   F.concat((k % 5 + 10).cast("string"), F.lit(",20,"), (k % 3 + 5).cast("string"), F.lit(",")).alias("block_sizes"), F.concat(F.lit("0,"), (k % 4 * 10 + 100).cast("string"), F.lit(",500,")).alias("block_starts"))
    return intervals.introns_of_bed12(bed, 100)


def _merge(s, d):
    i = intervals.merge_introns(_introns(s, d))
    return intervals.merge_jumps(intervals.jumps(i.filter("score >= 500"), 1), intervals.jumps(i.filter("score < 700"), 2))


def _splice(s, d):
    raw, refs = _scores(s, d)
    sc = intervals.splice_scores(raw, refs, 63, 0.8).withColumn("chrom", F.concat(F.lit("chr"), F.col("rid").cast("string"))).drop("strand", "type", "rid")
    return intervals.best_splice_scores(_regions(s, d), sc)


def _alt(s, d):
    refs = table(s, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("rid"))
    return intervals.mark_alt(refs, refs.filter("rid % 4 = 0").select("name").union(refs.filter("rid % 8 = 0").select("name"))).select("name", "rid", "is_alt")


def _names(s, d):
    refs = table(s, d, "customer").select(F.concat(F.lit("seq"), (F.col("c_custkey") % 100).cast("string")).alias("name"), F.col("c_custkey").alias("rid"))
    return index.name_to_id(refs)


def _dust(s, d):
    q = sketch.seeds(sequences(s, d), 15, 11)
    n = sequences(s, d).select("seq_id", F.length("seq").alias("n")).filter("n >= 40")
    masked = n.select("seq_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / 40).cast("int") - 1)).alias("i")).select("seq_id", (F.col("i") * 40).alias("st"), (F.col("i") * 40 + 12).alias("en"))
    return sketch.unmasked(q, masked).select("seq_id", "pos")


QUERIES = {
    "intron_blocks": _bed12,
    "intron_merge": lambda s, d: intervals.merge_introns(_introns(s, d)),
    "junction_merge": _merge,
    "junction_annot": lambda s, d: intervals.annotate_splice_signals(_regions(s, d), _introns(s, d)),
    "junction_jumps": lambda s, d: intervals.jumps_in(_regions(s, d), _merge(s, d)),
    "splice_lookup": _splice,
    "alt_mark": _alt,
    "name_to_id": _names,
    "dust_filter": _dust,
}

_I = "i AS (SELECT 'chr' || (o_orderkey % 23) AS chrom, (o_orderkey % 4999)*37 AS st, (o_orderkey % 4999)*37 + 100 + (o_orderkey % 7)*50 AS en, CAST(o_orderkey % 1000 AS INT) AS score, CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand FROM (SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey FROM orders))"
_M = "m AS (SELECT chrom, st, en, count(*) AS cnt, max(score) AS score, CASE WHEN min(strand) = max(strand) THEN min(strand) ELSE '.' END AS strand FROM i GROUP BY chrom, st, en)"
_R = "r AS (SELECT CAST(c_custkey AS BIGINT) AS region_id, 'chr' || (c_custkey % 23) AS chrom, (CAST(c_custkey AS BIGINT)*7919) % 180000 AS st, (CAST(c_custkey AS BIGINT)*7919) % 180000 + 1500 AS en FROM customer)"
_J = (f"{_I}, {_M}, s AS (SELECT *, 1 AS flag FROM m WHERE score >= 500 UNION ALL SELECT *, 2 FROM m WHERE score < 700), d AS (SELECT chrom, st AS off, en AS off2, cnt, flag FROM s UNION ALL SELECT chrom, en, st, cnt, flag FROM s), "
      "j AS (SELECT chrom, off, off2, CAST(sum(cnt) AS BIGINT) AS cnt, bit_or(flag) AS flag FROM d GROUP BY chrom, off, off2)")


def _dust_oracle():
    from . import oracle as O

    return (f"WITH {O.seqs()}, {O.seeds('t', 'b', 15, 11)}, k AS (SELECT seq_id, unnest(range(0, length(seq)//40)) * 40 AS st FROM b), "
            "o AS (SELECT t.seq_id, t.pos, sum(CASE WHEN k.st IS NULL THEN 0 ELSE greatest(0, least(t.pos + 1, k.st + 12) - greatest(t.pos - 14, k.st)) END) AS c FROM t LEFT JOIN k ON t.seq_id = k.seq_id AND k.st < t.pos + 1 AND k.st + 12 > t.pos - 14 GROUP BY t.seq_id, t.pos) "
            "SELECT seq_id, pos FROM o WHERE coalesce(c, 0) <= 7")


ORACLES = {
    "intron_blocks": "WITH k AS (SELECT CAST(o_orderkey AS BIGINT) AS k FROM orders), b AS (SELECT 'chr' || (k % 23) AS chrom, (k % 997)*10 AS s, k % 1000 AS score, CASE WHEN k % 2 = 0 THEN '+' ELSE '-' END AS strand, k % 5 + 10 AS b1, k % 4 * 10 + 100 AS o2 FROM k WHERE k % 1000 >= 100), "
    "i AS (SELECT chrom, s + b1 AS st, s + o2 AS en, score, strand FROM b UNION ALL SELECT chrom, s + o2 + 20, s + 500, score, strand FROM b), " + _M + " SELECT chrom, st, en, cnt, score, strand FROM m",
    "intron_merge": f"WITH {_I}, {_M} SELECT * FROM m",
    "junction_merge": f"WITH {_J} SELECT * FROM j",
    "junction_annot": f"WITH {_I}, {_R}, x AS (SELECT region_id, i.st - r.st AS a, i.en - 1 - r.st AS b, i.strand FROM r JOIN i ON r.chrom = i.chrom AND i.st >= r.st AND i.en <= r.en AND i.st < r.en), "
    "e AS (SELECT region_id, a AS pos, CASE WHEN strand = '+' THEN 1 ELSE 8 END AS bit FROM x UNION ALL SELECT region_id, b, CASE WHEN strand = '+' THEN 2 ELSE 4 END FROM x) SELECT region_id, pos, bit_or(bit) AS bits FROM e GROUP BY region_id, pos",
    "junction_jumps": f"WITH {_J}, {_R} SELECT region_id, off, off2, cnt, flag FROM r JOIN j ON r.chrom = j.chrom AND off > r.st AND off <= r.en",
    "splice_lookup": f"WITH {_R}, k AS (SELECT CAST(o_orderkey AS BIGINT) AS k FROM orders), s AS (SELECT 'chr' || (k % 29) AS chrom, (k*131) % 200000 AS pos, (k % 201 - 100)::DOUBLE*0.8::DOUBLE AS x FROM k WHERE k % 29 < 23), "
    "c AS (SELECT chrom, pos, greatest(-63, least(63, CASE WHEN x >= 0 THEN floor(x + 0.5) ELSE -floor(-x + 0.5) END)) AS score FROM s WHERE pos < 190000) "
    "SELECT region_id, pos - st AS pos, CAST(max(score) AS INT) AS score FROM r JOIN c ON r.chrom = c.chrom AND pos >= st AND pos < en GROUP BY region_id, pos - st",
    "alt_mark": "SELECT n_name AS name, n_nationkey AS rid, n_nationkey % 4 = 0 AS is_alt FROM nation",
    "name_to_id": "SELECT 'seq' || (c_custkey % 100) AS name, min(c_custkey) AS rid FROM customer GROUP BY 1",
    "dust_filter": _dust_oracle(),
}
