"""Readers of sequence records and of the tables that go with them.

Records are split by Spark's text source on their own separators, so a file is read by as many tasks
as it has splits, and compressed files are decompressed on the way. Lines are numbered within their
file, from the files' splits and where they begin, whatever tasks they come from.
"""

from __future__ import annotations

import io

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.seq import fragment_name, sequence_name

FASTQ_ENDINGS = (".fastq", ".fq", ".fastq.gz", ".fq.gz")


def detect_format(path: str) -> str:
    return "fastq" if path.lower().endswith(FASTQ_ENDINGS) else "fasta"


def read_sequences(spark: SparkSession, path: str, format: str | None = None, **options) -> DataFrame:
    """(rid, name, comment, seq, qual) of a FASTA or FASTQ file, plain or gzipped."""
    kind = format or detect_format(path)
    return read_fastq(spark, path, **options) if kind == "fastq" else read_fasta(spark, path, **options)


def _pieces(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """(file, n, value): a file's pieces between separators, numbered from 0 in their order, for every file of a path.

    A split's pieces lie in their order in one partition, and splits are ordered by file and where they
    begin. So pieces are numbered within splits, and a table with a row per split says how many come before.
    """
    raw = spark.read.option("lineSep", sep).text(path)
    raw = raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_begin"), F.monotonically_increasing_id().alias("_at"))
    splits = raw.groupBy("file", "_begin").agg(F.count("*").alias("_n"))
    skip = F.coalesce(F.sum("_n").over(Window.partitionBy("file").orderBy("_begin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("file", "_begin").orderBy("_at"))
    both = raw.withColumn("_i", inside).join(F.broadcast(splits.select("file", "_begin", skip.alias("_skip"))), ["file", "_begin"])  # a row per split
    return both.select("file", (F.col("_skip") + F.col("_i") - 1).alias("n"), "value")


def _over_files(records: DataFrame) -> DataFrame:
    """(file, n, ...) -> with ``rid``: records counted through the files in the order of their paths, empty places left out."""
    block = F.floor(F.col("n") / 65536)
    r = records.withColumn("_block", block)
    counts = r.groupBy("file", "_block").agg(F.count("*").alias("_c"))
    skip = F.coalesce(F.sum("_c").over(Window.orderBy("file", "_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per 65536 records
    inside = F.row_number().over(Window.partitionBy("file", "_block").orderBy("n"))
    both = r.withColumn("_i", inside).join(F.broadcast(counts.select("file", "_block", skip.alias("_skip"))), ["file", "_block"])
    return both.withColumn("rid", F.col("_skip") + F.col("_i") - 1).drop("_skip", "_i", "_block")


def read_fasta(spark: SparkSession, path: str, u_to_t: bool = True) -> DataFrame:
    """Records begin at a '>' wherever it stands; the first line of a file is a header even without one."""
    raw = _pieces(spark, path, ">").filter(F.length(F.trim("value")) > 0)
    lines = F.split(F.regexp_replace("value", "\r", ""), "\n")
    body = F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), "")
    seq = F.translate(body, "Uu", "Tt") if u_to_t else body
    header = F.element_at(lines, 1)
    out = raw.select("file", "n", sequence_name(header).alias("name"), F.regexp_extract(header, r"^\S*\s+(.*)$", 1).alias("comment"), seq.alias("seq"), F.lit(None).cast("string").alias("qual"))
    return _over_files(out).select("rid", "name", "comment", "seq", "qual")


def read_fastq(spark: SparkSession, path: str, u_to_t: bool = True, with_qual: bool = True) -> DataFrame:
    """Exactly four lines a record of a file, neither '@' nor '+' checked; carriage returns and byte order marks are dropped."""
    lines = _pieces(spark, path, "\n").withColumn("value", F.regexp_replace("value", "[\r" + chr(0xFEFF) + "]", ""))
    at = lambda k: F.max(F.when(F.col("n") % 4 == k, F.col("value")))
    r = lines.groupBy("file", F.floor(F.col("n") / 4).alias("n")).agg(at(0).alias("h"), at(1).alias("s"), at(3).alias("q")).filter("h <> '' or s <> ''")
    h = F.regexp_replace("h", "^@", "")
    seq = F.translate("s", "Uu", "Tt") if u_to_t else F.col("s")
    out = r.select("file", "n", sequence_name(h).alias("name"), F.regexp_extract(h, r"^\S*\s+(.*)$", 1).alias("comment"), seq.alias("seq"), (F.col("q") if with_qual else F.lit(None).cast("string")).alias("qual"))
    return _over_files(out).select("rid", "name", "comment", "seq", "qual")


def read_paired(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two files read in step, up to the end of the shorter one: records of equal number are mates."""
    a = first.select("rid", F.lit(0).alias("seg"), "name", "seq", "qual")
    b = second.select("rid", F.lit(1).alias("seg"), "name", "seq", "qual")
    both = a.select("rid").join(b.select("rid"), "rid")
    return a.union(b).join(both, "rid", "left_semi").select(F.col("rid").alias("frag_id"), "seg", fragment_name(F.col("name")).alias("name"), "seq", "qual")


def fragments(reads: DataFrame) -> DataFrame:
    """Consecutive reads of one name, mate numbers aside, as a fragment: with frag_id (its first rid) and seg.

    Names are compared with the previous record's; records are dealt by number in blocks of a fixed
    size with their predecessor at hand, so no window spans the file.
    """
    r = reads.withColumn("_name", fragment_name(F.col("name")))
    prev = r.select((F.col("rid") + 1).alias("rid"), F.col("_name").alias("_before"))
    r = r.join(prev, "rid", "left").withColumn("_new", F.coalesce(F.col("_name") != F.col("_before"), F.lit(True)))
    block = F.floor(F.col("rid") / 65536)
    last_start = F.last(F.when(F.col("_new"), F.col("rid")), True)
    r = r.withColumn("_block", block)
    inside = r.withColumn("_f", last_start.over(Window.partitionBy("_block").orderBy("rid")))
    starts = r.filter("_new").groupBy("_block").agg(F.max("rid").alias("_s"))
    # every block has its row, also one that a fragment runs all through
    starts = r.select("_block").distinct().join(starts, "_block", "left")
    carry = starts.withColumn("_carry", F.last("_s", True).over(Window.orderBy("_block"))).select((F.col("_block") + 1).alias("_block"), "_carry")
    out = inside.join(F.broadcast(carry), "_block", "left").withColumn("frag_id", F.coalesce("_f", "_carry"))
    return out.withColumn("seg", F.col("rid") - F.col("frag_id")).select("frag_id", "seg", "rid", F.col("_name").alias("name"), "seq", "qual")


def read_standard_input(spark: SparkSession, stream, kind: str = "fasta", batch: int = 10_000) -> DataFrame:
    """Records of a pipe, parsed as it is read; they go to the shared folder batch by batch and so need not fit the driver."""
    from ..runtime import scratch_path
    from ..streaming.record_stream import advance

    path, state, held, at = scratch_path(spark), (0, 0, "", {}), [], 0
    schema = "rid long, name string, comment string, seq string, qual string"
    spark.createDataFrame([], schema).write.parquet(path)
    text = io.TextIOWrapper(stream, encoding="utf-8", newline="")
    while True:
        chunk = text.read(1 << 22)
        state, out = advance(state, [(at, chunk, not chunk)], kind)
        at += len(chunk)
        held += out
        if held and (len(held) >= batch or not chunk):
            spark.createDataFrame(held, schema).write.mode("append").parquet(path)
            held = []
        if not chunk:
            return spark.read.schema(schema).parquet(path)


def from_strings(spark: SparkSession, seqs: list[str], names: list[str] | None = None) -> DataFrame:
    """A few sequences at hand as records."""
    rows = [(i, names[i] if names else str(i), "", s, None) for i, s in enumerate(seqs)]
    return spark.createDataFrame(rows, "rid long, name string, comment string, seq string, qual string")


def references(reads: DataFrame) -> DataFrame:
    return reads.select("rid", "name", F.length("seq").cast("long").alias("len"), F.lit(False).alias("is_alt"), "seq")


def longest_id(reads: DataFrame) -> DataFrame:
    return reads.agg(F.coalesce(F.max(F.length("name")), F.lit(0)).alias("max_id_len"))


def read_bed12(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a BED file with the columns introns are read from."""
    t = spark.read.text(path).filter(~F.col("value").rlike(r"^(#|track|browser)")).select(F.split("value", "\t").alias("c")).filter(F.size("c") >= 3)
    get = lambda i: F.get(F.col("c"), F.lit(i))
    return t.select(get(0).alias("chrom"), get(1).cast("long").alias("start"), get(2).cast("long").alias("end"), F.coalesce(F.expr("try_cast(get(c, 4) as long)"), F.lit(0)).alias("score"), F.coalesce(get(5), F.lit(".")).alias("strand"),
                    F.coalesce(get(10), F.lit("")).alias("block_sizes"), F.coalesce(get(11), F.lit("")).alias("block_starts"))


def read_splice_scores(spark: SparkSession, path: str) -> DataFrame:
    """chrom, pos, strand, type, score by tabs."""
    return spark.read.csv(path, sep="\t", schema="chrom string, pos long, strand string, type string, score double")


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """First words of lines: a contig list."""
    return spark.read.text(path).select(sequence_name(F.col("value")).alias("name")).filter("name <> ''")


def packed_2bit(seqs: DataFrame) -> DataFrame:
    """(seq_id, packed, n): four bases a byte, low bits first; what is no base counts as A."""
    from ..runtime import map_arrow

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from ..functions.kernels import sequences

        for b in batches:
            codes, off = sequences(b.column(1))
            out = []
            for a, e in zip(off[:-1].tolist(), off[1:].tolist()):
                c = np.zeros(-(-(e - a) // 4) * 4, np.uint8)
                c[: e - a] = codes[a:e]
                c = c.reshape(-1, 4)
                out.append((c[:, 0] | c[:, 1] << 2 | c[:, 2] << 4 | c[:, 3] << 6).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary()), pa.array(np.diff(off))], ["seq_id", "packed", "n"])

    return map_arrow(seqs.select("seq_id", "seq"), run, "seq_id long, packed binary, n long")


def unpacked_2bit(packed: DataFrame) -> DataFrame:
    """(seq_id, packed, n) -> (seq_id, seq)."""
    from ..runtime import map_arrow

    def run(batches):
        import numpy as np
        import pyarrow as pa

        letters = np.frombuffer(b"ACGT", np.uint8)
        for b in batches:
            out = []
            for x, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                c = np.frombuffer(x, np.uint8)
                c = np.stack([c >> s & 3 for s in (0, 2, 4, 6)], 1).ravel()[:n]
                out.append(letters[c].tobytes().decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["seq_id", "seq"])

    return map_arrow(packed.select("seq_id", "packed", "n"), run, "seq_id long, seq string")
