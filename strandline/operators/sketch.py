"""Sampling operators: DataFrames of sequences to DataFrames of hits.

Input: (seq_id, seq) with bases only; where a key takes several columns, seq_id is a struct of them. Each operator is one pass of an Arrow kernel over the rows as
they lie: no shuffle, and whatever follows is planned by Catalyst.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..runtime import map_arrow


#: Letters that a kernel treats at once; its arrays take some hundred bytes a letter.
KERNEL_LETTERS = 1 << 18


def _few(batches, letters: int = KERNEL_LETTERS):
    """Batches of (seq_id, seq) in pieces of so many letters at most, or of one sequence."""
    for b in batches:
        ends = np.cumsum(pc.binary_length(b.column(1)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < b.num_rows:
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + letters, "right")))
            yield b.slice(at, upto - at)
            at = upto


def _ids_at(ids: pa.Array, off: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Sequence ids of places, and places within their sequences."""
    row = np.searchsorted(off, at, "right") - 1
    return ids.take(pa.array(row)), at - off[row]


def _id_kind(seqs: DataFrame) -> str:
    return seqs.schema["seq_id"].dataType.simpleString()


def minimizers(seqs: DataFrame, k: int = 15, w: int = 11, canonical: bool = True, block_compat: bool = False) -> DataFrame:
    """(seq_id, pos, hash): pos is a k-mer's begin, the hash has its low 8 bits cleared."""
    def run(batches):
        for b in _few(batches):
            codes, off = K.sequences(b.column(1))
            at, h = K.minimizer_places(codes, off, k, w, canonical, 128 if block_compat else None)
            ids, pos = _ids_at(b.column(0), off, at)
            yield pa.RecordBatch.from_arrays([ids, pa.array(pos, pa.int64()), pa.array(h.astype(np.int64))], ["seq_id", "pos", "hash"])

    return map_arrow(seqs.select("seq_id", "seq"), run, f"seq_id {_id_kind(seqs)}, pos long, hash long")


def syncmers(seqs: DataFrame, k: int = 31, s: int = 11, t: int = 0, closed: bool = True, strict: bool = False, canonical: bool = True) -> DataFrame:
    """(seq_id, pos) of closed, open (at offset t) or strict open syncmers."""
    if s > 16:
        raise ValueError("s-mers have at most 16 bases")

    def run(batches):
        for b in _few(batches):
            codes, off = K.sequences(b.column(1))
            ids, pos = _ids_at(b.column(0), off, K.syncmer_places(codes, off, k, s, t, closed, strict, canonical))
            yield pa.RecordBatch.from_arrays([ids, pa.array(pos, pa.int64())], ["seq_id", "pos"])

    return map_arrow(seqs.select("seq_id", "seq"), run, f"seq_id {_id_kind(seqs)}, pos long")


def smer_hashes(seqs: DataFrame, s: int = 11, canonical: bool = True) -> DataFrame:
    """(seq_id, n, digest): how many s-mers a sequence has, and the XOR of their hashes."""
    def run(batches):
        for b in _few(batches):
            codes, off = K.sequences(b.column(1))
            h = K.kmer_hashes(codes, s, canonical)
            ok = K.fits(off, len(h), s)
            n, digest = [], []
            for a, e in zip(off[:-1].tolist(), off[1:].tolist()):
                part = h[a:e][ok[a:e]]
                n.append(len(part))
                digest.append(int(np.bitwise_xor.reduce(part)) if len(part) else 0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.int64())], ["seq_id", "n", "digest"])

    return map_arrow(seqs.select("seq_id", "seq"), run, "seq_id long, n long, digest long")


def sampled_kmers(seqs: DataFrame, k: int = 15, w: int = 11, sampler: str = "minimizer", s: int = 11, mixed: bool = False, canonical: bool = True) -> DataFrame:
    """(seq_id, pos, kmer, strand): sampling and harvesting in one pass.

    ``kmer`` is the (canonical, optionally mixed) 64-bit code as a signed long; strand is 1 where the
    reverse complement is the lesser code.
    """
    def run(batches):
        for b in _few(batches):
            codes, off = K.sequences(b.column(1))
            at = K.minimizer_places(codes, off, k, w)[0] if sampler == "minimizer" else K.syncmer_places(codes, off, k, s)
            x, strand = K.harvested(codes, at, k, canonical, mixed)
            ids, pos = _ids_at(b.column(0), off, at)
            yield pa.RecordBatch.from_arrays([ids, pa.array(pos, pa.int64()), pa.array(x.view(np.int64)), pa.array(strand.astype(np.int32))], ["seq_id", "pos", "kmer", "strand"])

    return map_arrow(seqs.select("seq_id", "seq"), run, f"seq_id {_id_kind(seqs)}, pos long, kmer long, strand int")


def seeds(seqs: DataFrame, k: int = 15, w: int = 11) -> DataFrame:
    """(seq_id, key, span, pos, strand): minimizers for seeding; pos is the k-mer's last base."""
    def run(batches):
        for b in _few(batches):
            codes, off = K.sequences(b.column(1))
            at, _ = K.minimizer_places(codes, off, k, w)
            x, strand = K.harvested(codes, at, k, True, False)
            ids, pos = _ids_at(b.column(0), off, at)
            key = K.masked64(x, k)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(key.view(np.int64)), pa.array(np.full(len(at), k, np.int32)), pa.array(pos + k - 1, pa.int64()), pa.array(strand.astype(np.int32))],
                ["seq_id", "key", "span", "pos", "strand"])

    return map_arrow(seqs.select("seq_id", "seq"), run, "seq_id long, key long, span int, pos long, strand int")


#: Letters of a sequence that are sketched at once.
SKETCH_BLOCK = 1 << 20


def native_seeds(seqs: DataFrame, k: int = 15, w: int = 10, compressed: bool = False, spread: bool = False, block: int = SKETCH_BLOCK) -> DataFrame:
    """(seq_id, key, span, pos, strand) with ties, strand, and optional homopolymer compression.

    With an odd ``k`` and without compression long sequences are sketched in blocks that overlap as far as windows reach, each of
    which gives the minimizers that end in it, so no worker holds a chromosome's seeds; ``spread`` deals the blocks to all tasks.
    Otherwise what a window holds has no bound in letters, and a sequence is sketched as a whole.
    """
    if not (0 < w < 256 and 0 < k <= 28):
        raise ValueError("0 < w < 256 and 0 < k <= 28")
    if block < w:
        raise ValueError("a block holds a window at least")
    schema = "seq_id long, key long, span int, pos long, strand int"
    names = [c.split()[0] for c in schema.split(", ")]

    def batches_of(found):
        """Columns of single sequences as batches of a bounded number of seeds, or of one sequence's."""
        held, out = 0, []

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32()))], names)

        for columns in found:
            out.append(columns)
            held += len(columns[0])
            if held >= 1 << 17:
                yield batch()
                held, out = 0, []
        if out:
            yield batch()

    def whole(batches):
        def found():
            for b in batches:
                for i, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    seeds = K.native_sketch(s or "", w, k, compressed)
                    yield np.full(len(seeds), i), *np.array(seeds, np.int64).reshape(-1, 4).T

        yield from batches_of(found())

    def pieces(batches):
        def found():
            for b in batches:
                for part in _few([b]):
                    ids, first, own, n = (part.column(c).to_numpy() for c in (0, 2, 3, 4))
                    texts = part.column(1).to_pylist()
                    ends = first + np.array([len(t) for t in texts]) == n
                    key, piece, at, strand = K.block_sketches([t.encode() for t in texts], w, k, own - first, own - first + block, ends)
                    yield ids[piece], key.view(np.int64), np.full(len(key), k), at + first[piece], strand

        yield from batches_of(found())

    if compressed or k % 2 == 0:
        return map_arrow(seqs.select("seq_id", "seq"), whole, schema)
    n = F.length("seq").cast("long")
    b = seqs.filter("seq <> ''").select("seq_id", "seq", n.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / block))).alias("_b"))
    own = F.col("_b") * block
    first = F.greatest(own - (w + k - 2), F.lit(0))
    piece = F.substring("seq", (first + 1).cast("int"), (own + block + w - 1 - first).cast("int"))
    b = b.select("seq_id", piece.alias("seq"), first.alias("first"), own.alias("own"), "n")
    if spread:
        b = b.repartition("seq_id", "own")
    return map_arrow(b, pieces, schema)


def low_complexity(seqs: DataFrame, threshold: int = 20, window: int = 64) -> DataFrame:
    """(seq_id, st, en) of masked stretches."""
    def run(batches):
        for b in batches:
            rows = [(i, *r) for i, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for r in K.dust(s or "", threshold, window)]
            c = list(zip(*rows)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in c], ["seq_id", "st", "en"])

    return map_arrow(seqs.select("seq_id", "seq"), run, "seq_id long, st long, en long")


def unmasked(seeds_df: DataFrame, masked: DataFrame) -> DataFrame:
    """Seeds that masked stretches cover by no more than half of their span.

    A range join by bins of 256 bases: an interval joins only where its bins are.
    """
    bin_ = 256
    s = seeds_df.withColumn("_a", F.col("pos") - F.col("span") + 1).withColumn("_b", F.col("pos") + 1)
    sb = s.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_a") / bin_), F.floor((F.col("_b") - 1) / bin_))))
    mb = masked.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("st") / bin_), F.floor((F.col("en") - 1) / bin_))))
    low, high = F.col("_bin") * bin_, (F.col("_bin") + 1) * bin_
    part = F.least("_b", "en", high) - F.greatest("_a", "st", low)
    hit = sb.join(mb, ["seq_id", "_bin"]).withColumn("_o", F.greatest(part, F.lit(0)))
    cover = hit.groupBy("seq_id", "pos", "span").agg(F.sum("_o").alias("_o"))
    out = s.join(cover, ["seq_id", "pos", "span"], "left").filter(F.coalesce("_o", F.lit(0)) <= F.shiftright("span", 1))
    return out.select(*seeds_df.columns)


def segments(texts: DataFrame, id_col: str = "seq_id", text_col: str = "text") -> DataFrame:
    """(seq_id, file_offset, logical_len, type): maximal stretches of bases (BASES) and of others (N_GAP)."""
    return _stretches(texts, id_col, text_col).drop("run")


def _stretches(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    runs = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit("[ACGTacgt]+|[^ACGTacgt]+"), F.lit(0))
    r = texts.select(F.col(id_col).alias("seq_id"), F.posexplode(runs).alias("i", "run"))
    before = Window.partitionBy("seq_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    n = F.length("run").cast("long")
    return r.select("seq_id", F.coalesce(F.sum(n).over(before), F.lit(0)).alias("file_offset"), n.alias("logical_len"),
                    F.when(F.col("run").rlike("^[ACGTacgt]"), "BASES").otherwise("N_GAP").alias("type"), "run")


def runs_of_bases(texts: DataFrame, id_col: str = "seq_id", text_col: str = "text") -> DataFrame:
    """(seq_id, start, seq): stretches of bases as sequences of their own; no k-mer spans a gap."""
    return _stretches(texts, id_col, text_col).filter("type = 'BASES'").select("seq_id", F.col("file_offset").alias("start"), F.upper("run").alias("seq"))


def halo_blocks(seqs: DataFrame, size: int, k: int, w: int = 1) -> DataFrame:
    """(seq_id, start, own_from, own_to, seq): long sequences in blocks that overlap as far as windows reach.

    A block owns window begins [start, start + size); one window to the left is there to tell a change.
    """
    n = F.length("seq")
    blocks = F.sequence(F.lit(0), F.floor(F.greatest(n - 1, F.lit(0)) / size).cast("int"))
    b = seqs.select("seq_id", "seq", F.explode(blocks).alias("_b")).withColumn("own_from", F.col("_b") * size)
    left = F.greatest(F.col("own_from") - 1, F.lit(0))
    return b.select("seq_id", left.alias("start"), "own_from", (F.col("own_from") + size).alias("own_to"),
                    F.substring("seq", (left + 1).cast("int"), F.lit(size + 1 + k - 1 + w - 1)).alias("seq"))
