"""Queries whose operators are sequential per sequence, query or pair, so that SQL has no form of them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions.seq import bases, reverse_complement
from ..operators import alignment as A
from ..operators import chaining, intervals, sketch
from ..runtime import map_arrow
from ..sinks import formats
from . import mapper
from .index_queries import _anchors
from .options import preset
from .sketch_queries import sequences, table


def _records(s, d, name, id_col, prefix):
    return table(s, d, name).select(F.col(id_col).alias("rid"), F.concat(F.lit(prefix), F.col(id_col).cast("string")).alias("name"), bases("text").alias("seq"))


def _options():
    return preset(k=11, w=5, min_cnt=2, min_chain_score=18, min_dp_max=20)


def _chains(s, d):
    return chaining.chains(_anchors(s, d), chaining.ChainOptions(min_cnt=2, min_score=15))


def _long_chains(s, d):
    return chaining.chains(_anchors(s, d), chaining.ChainOptions(min_cnt=2, min_score=15), long_gaps=True)


def _mapped(s, d, aligned=True):
    return mapper.map_reads(_records(s, d, "benchmark", "item_id", "item"), _records(s, d, "documents", "doc_id", "doc"), _options(), aligned)


def _paf(s, d):
    return formats.full_paf(_mapped(s, d))


def _sam(s, d):
    reads = _records(s, d, "benchmark", "item_id", "item").select(F.col("rid").alias("qid"), F.col("name").alias("qname"), F.length("seq").cast("long").alias("qlen"), "seq", F.lit(None).cast("string").alias("qual"))
    found = formats.with_unmapped(_mapped(s, d), reads.select("qid", "qname", "qlen")).withColumn("seg", F.lit(0))
    return formats.sam(found.join(reads.select("qid", "seq", "qual"), "qid"))


def _short_pairs(s, d):
    """Halves of benchmark items as mates that face each other, mapped to the documents as short reads."""
    b = _records(s, d, "benchmark", "item_id", "item").withColumn("half", F.floor(F.length("seq") / 2).cast("int"))
    mate = lambda seg, seq: b.select(F.col("rid").alias("frag_id"), F.lit(seg).alias("seg"), "name", seq.alias("seq"))
    reads = mate(0, F.substring("seq", F.lit(1), F.col("half"))).union(mate(1, reverse_complement(F.substring("seq", F.col("half") + 1, F.length("seq")))))
    o = preset("sr", k=11, w=5, min_cnt=2, min_chain_score=12, min_dp_max=20)
    m = mapper.map_pairs(reads, _records(s, d, "documents", "doc_id", "doc"), o)
    return m.select("frag", "seg", "tname", "rev", "qs", "qe", "rs", "re", "rank", "parent", "primary", "proper", "mapq", "cigar")


def _spliced(s, d):
    """Benchmark items without their middle third mapped as spliced reads to the whole items and the documents; the thirds are
    known introns and jumps."""
    b = _records(s, d, "benchmark", "item_id", "item").withColumn("third", F.floor(F.length("seq") / 3).cast("int"))
    third = F.col("third")
    reads = b.select("rid", "name", F.concat(F.substring("seq", F.lit(1), third), F.substring("seq", 2 * third + 1, F.length("seq"))).alias("seq"))
    introns = b.filter("third > 0").select(F.col("name").alias("chrom"), third.cast("long").alias("st"), (2 * third).cast("long").alias("en"), F.lit("+").alias("strand"), F.lit(1).alias("score"))
    merged = intervals.merge_introns(introns)
    known = mapper.Known(merged, jumps=intervals.jumps(merged, 1))
    o = preset("splice", k=11, w=5, min_cnt=2, min_chain_score=18, min_dp_max=20, gap_open2=20, junction_bonus=14)
    items = b.select((F.col("rid") + (1 << 40)).alias("rid"), "name", "seq")  # beside the documents' numbers
    m = mapper.map_reads(reads, items.unionByName(_records(s, d, "documents", "doc_id", "doc")), o, known=known)
    return m.select("qname", "qlen", "tname", "rev", "qs", "qe", "rs", "re", "rank", "parent", "primary", "mapq", "dp_score", "trans", "cigar")


def _pairwise(s, d):
    """Neighbouring benchmark items aligned with each other: global, dual and single cost, and local."""
    b = sequences(s, d, "benchmark", "item_id").filter(F.length("seq") > 0)
    n = b.select((F.col("seq_id") - 1).alias("seq_id"), F.col("seq").alias("other"))
    pairs = b.select("seq_id", "seq").join(n, "seq_id")

    def run(batches):
        for x in batches:
            rows = []
            for i, q, t in zip(x.column("seq_id").to_pylist(), x.column("seq").to_pylist(), x.column("other").to_pylist()):
                one, two = A.align(q, t, dual=False), A.align(q, t)
                c = A.left_aligned(two.cigar, q, t)
                rows.append((i, one.score, two.score, A.local_score(q, t), A.text(c), A.md_tag(c, q, t), A.cs_tag(c, q, t)))
            c = list(zip(*rows)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in c[:4]] + [pa.array(v, pa.string()) for v in c[4:]], ["seq_id", "single", "dual", "local", "cigar", "md", "cs"])

    return map_arrow(pairs, run, "seq_id long, single long, dual long, local long, cigar string, md string, cs string")


QUERIES = {
    "sketch_native": lambda s, d: sketch.native_seeds(sequences(s, d), 15, 10),
    "sketch_native_hpc": lambda s, d: sketch.native_seeds(sequences(s, d, "benchmark", "item_id"), 11, 5, True),
    "sdust": lambda s, d: sketch.low_complexity(sequences(s, d, "benchmark", "item_id")),
    "chains": _chains,
    "chains_long_gaps": _long_chains,
    "parents": lambda s, d: mapper.regions_of(chaining.chain_rows(_anchors(s, d), chaining.ChainOptions(min_cnt=2, min_score=15)), _options()).select("qid", "tid", "rev", "rank", "parent", "subsc", "n_sub"),
    "mappings": lambda s, d: _mapped(s, d, False),
    "align_affine": _pairwise,
    "pairs_sr": _short_pairs,
    "spliced_known": _spliced,
    "paf": _paf,
    "sam": _sam,
}
ORACLES: dict = {}
