"""Command line: ``python -m strandline scan FILE`` and ``python -m strandline map REFS READS OUT``.

``map`` takes every field of the mapping options as an option of its own, with dashes (``--min-chain-score 30``);
``-`` as a file is standard input.
"""

from __future__ import annotations

import argparse
import sys
import time
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import index, intervals, sketch
from .plans import mapper
from .plans.options import PRESETS, Options, preset
from .sinks import formats
from .sources.records import longest_id, read_bed12, read_paired, read_sequences, read_splice_scores, read_standard_input


def _read(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    return read_standard_input(spark, sys.stdin.buffer, kind or "fasta") if path == "-" else read_sequences(spark, path, kind)


def _scan(spark: SparkSession, a) -> None:
    reads = _read(spark, a.file, "fastq" if a.fastq else None)
    if a.profile:
        print(longest_id(reads).first()[0])
        return
    began = time.time()
    runs = sketch.runs_of_bases(reads.select("rid", "seq"), "rid", "seq").select("seq_id", "seq")
    hits = sketch.syncmers(runs, a.k, a.s) if a.mode == "syncmer" else sketch.minimizers(runs, a.k, a.w)
    n = hits.count()
    bases = runs.agg(F.coalesce(F.sum(F.length("seq")), F.lit(0))).first()[0]
    print(f"RESULT|{a.mode}|bases={bases}|hits={n}|density={n / max(bases, 1):.6f}|seconds={time.time() - began:.3f}")


def _statistics(x: mapper.Index) -> str:
    total = x.refs.agg(F.coalesce(F.sum(F.length("seq").cast("long")), F.lit(0)).alias("total_length"))
    s = index.stats(x.counts, total).first()
    return "RESULT|index|" + "|".join(f"{k}={v}" for k, v in s.asDict().items())


def _known(spark: SparkSession, a, x: mapper.Index) -> mapper.Known | None:
    """What the command line names of introns: annotation and jumps as BED12, splice scores as a table."""
    if not (a.introns or a.splice_scores or a.jumps or a.more_jumps):
        return None
    introns = intervals.introns_of_bed12(read_bed12(spark, a.introns)) if a.introns else None
    scores = None
    if a.splice_scores:
        o, refs = x.options, x.refs.select("name", "rid", F.length("seq").alias("len"))
        most = min(63, max((o.gap_open2 + 1) // 2 - 1, o.gap_open2 - o.gap_open))
        scores = intervals.splice_scores(read_splice_scores(spark, a.splice_scores), refs, most, a.splice_score_scale).filter("pos > 0")
    found = [intervals.jumps(intervals.introns_of_bed12(read_bed12(spark, path)), flag).drop("strand") for path, flag in ((a.jumps, 1), (a.more_jumps, 2)) if path]
    return mapper.Known(introns, scores, intervals.merge_jumps(*found) if found else None)


def _map(spark: SparkSession, a) -> None:
    given = {f.name: v for f in fields(Options) if (v := getattr(a, f.name)) is not None}
    o = preset(a.preset, **given)
    x = mapper.load_index(spark, a.refs, o) if a.index else mapper.build_index(_read(spark, a.refs), o)
    if a.save_index:
        mapper.save_index(x, a.save_index)
    if a.statistics:
        print(_statistics(x))
    reads, known = _read(spark, a.reads), _known(spark, a, x)
    if a.mates:
        both = read_paired(reads, _read(spark, a.mates))
        found = mapper.map_pairs(both, x, known=known)
        q = both.withColumn("qid", F.col("frag_id") * 2 + F.col("seg"))
    else:
        found = mapper.map_reads(reads, x, known=known).withColumn("seg", F.lit(0))
        q = reads.withColumn("qid", F.col("rid")).withColumn("seg", F.lit(0))
    found = mapper.written(found, x.options)
    lengths = q.select("qid", F.col("name").alias("qname"), F.length("seq").cast("long").alias("qlen"), "seg")
    found = formats.with_unmapped(found, lengths)
    if a.sam:
        found = found.withColumn("paired", F.lit(bool(a.mates))).withColumn("inv", F.coalesce("inv", F.lit(False)))
        if "proper" in found.columns:
            found = found.withColumn("proper", F.coalesce("proper", F.lit(False)))
        body = formats.sam(found.join(q.select("qid", "seq", "qual"), "qid")).select("value")
        head = formats.sam_header(spark, x.refs.select("rid", "name", F.length("seq").alias("len")), a.read_group).orderBy("ord").select("value")
        head.coalesce(1).write.mode("overwrite").text(a.out + "/header")
        formats.write_lines(body, a.out + "/records")
    elif a.junctions:
        formats.write_lines(formats.junctions(found.filter("tname is not null"), x.refs), a.out)
    else:
        formats.write_lines(formats.full_paf(found, tuple(t for t, on in (("cs", a.cs), ("ds", a.ds), ("MD", a.md), ("cg", not a.no_cigar)) if not on)), a.out)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="strandline")
    sub = p.add_subparsers(dest="command", required=True)
    scan = sub.add_parser("scan", help="sample a file and print counts")
    scan.add_argument("file")
    scan.add_argument("-m", "--mode", choices=("syncmer", "minimizer"), default="syncmer")
    scan.add_argument("-k", type=int, default=31)
    scan.add_argument("-s", type=int, default=11)
    scan.add_argument("-w", type=int, default=21)
    scan.add_argument("--fastq", action="store_true")
    scan.add_argument("--profile", action="store_true", help="print the longest name only")
    m = sub.add_parser("map", help="map reads to references")
    m.add_argument("refs")
    m.add_argument("reads")
    m.add_argument("out")
    m.add_argument("-x", "--preset", choices=sorted(PRESETS))
    m.add_argument("-a", "--sam", action="store_true")
    m.add_argument("-2", "--mates", help="the second file of read pairs")
    m.add_argument("--index", action="store_true", help="refs is a saved index")
    m.add_argument("--save-index")
    m.add_argument("--statistics", action="store_true", help="print what the index holds")
    m.add_argument("--read-group")
    m.add_argument("--junctions", action="store_true", help="write introns as BED")
    m.add_argument("--introns", help="known introns as BED12, cheaper in spliced alignments")
    m.add_argument("--splice-scores", help="scores of splice sites by tabs, instead of known introns")
    m.add_argument("--splice-score-scale", type=float, default=0.7)
    m.add_argument("--jumps", help="annotated introns as BED12 that ends of spliced alignments go over")
    m.add_argument("--more-jumps", help="further ones, such as those of a first pass")
    m.add_argument("--cs", action="store_true")
    m.add_argument("--ds", action="store_true")
    m.add_argument("--md", action="store_true")
    m.add_argument("--no-cigar", action="store_true")
    for f in fields(Options):
        flag = "--" + f.name.replace("_", "-")
        if f.type in ("bool", bool):
            m.add_argument(flag, dest=f.name, action="store_const", const=True)
        else:
            m.add_argument(flag, dest=f.name, type=float if f.type in ("float", float) else int)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("strandline").getOrCreate()
    (_scan if a.command == "scan" else _map)(spark, a)


if __name__ == "__main__":
    main()
