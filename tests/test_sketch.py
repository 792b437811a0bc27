import random

import numpy as np
import pyarrow as pa
import pytest

from strandline.functions import kernels as K
from strandline.operators import sketch
from strandline.streaming.sketch_stream import advance
from tests import scalar

rng = random.Random(42)
SEQS = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (0, 1, 14, 15, 24, 25, 26, 41, 200, 1500)] + ["A" * 200, "AC" * 60, "ACGT" * 40]


def batch():
    return K.sequences(pa.array(SEQS))


def split(off, at):
    row = np.searchsorted(off, at, "right") - 1
    out = [[] for _ in SEQS]
    for r, p in zip(row.tolist(), (at - off[row]).tolist()):
        out[r].append(p)
    return out


@pytest.mark.parametrize("k,w,canonical", [(15, 11, True), (31, 21, True), (15, 31, False), (10, 5, True)])
def test_minimizers(k, w, canonical):
    codes, off = batch()
    at, h = K.minimizer_places(codes, off, k, w, canonical)
    want = [scalar.minimizers(s, k, w, canonical) for s in SEQS]
    assert split(off, at) == [[p for p, _ in x] for x in want]
    assert h.tolist() == [v for x in want for _, v in x]


@pytest.mark.parametrize("k,s,t,closed,strict,canonical", [(31, 11, 0, True, False, True), (21, 11, 0, True, False, True), (15, 5, 0, True, False, True), (31, 11, 10, False, False, True), (31, 11, 5, False, False, True), (31, 11, 0, True, True, True), (21, 11, 0, True, False, False)])
def test_syncmers(k, s, t, closed, strict, canonical):
    codes, off = batch()
    at = K.syncmer_places(codes, off, k, s, t, closed, strict, canonical)
    assert split(off, at) == [scalar.syncmers(x, k, s, t, closed, strict, canonical) for x in SEQS]


def test_syncmer_rejects_long_smers():
    with pytest.raises(ValueError):
        K.syncmer_places(*batch(), 31, 17)


def test_homopolymer_ties():
    codes, off = K.sequences(pa.array(["A" * 200]))
    assert len(K.syncmer_places(codes, off, 31, 11)) == 170 == len(K.syncmer_places(codes, off, 31, 11, 10, False))
    assert K.minimizer_places(codes, off, 15, 11)[0].tolist() == list(range(176))


def test_reverse_complement_mirrors_closed_syncmers():
    s = SEQS[9]
    a, b = (K.syncmer_places(*K.sequences(pa.array([x])), 31, 11).tolist() for x in (s, scalar.rc(s)))
    assert a == sorted(len(s) - 31 - p for p in b)


def test_harvest_and_hashes():
    s = SEQS[9]
    codes, off = K.sequences(pa.array([s]))
    at = np.arange(0, len(s) - 31, 7)
    for k in (15, 31):
        x, strand = K.harvested(codes, at, k)
        want = [min(scalar.code(s[p : p + k]), scalar.code(scalar.rc(s[p : p + k]))) for p in at]
        assert x.tolist() == [scalar.mix64(c) for c in want]
        assert strand.tolist() == [scalar.code(scalar.rc(s[p : p + k])) < scalar.code(s[p : p + k]) for p in at]
    for k in (15, 21, 28):
        x = np.array([rng.getrandbits(2 * k) for _ in range(200)], np.uint64)
        assert K.masked64(x, k).tolist() == [scalar.masked_hash(int(v), k) for v in x]


def test_reverse_complement_of_many_kmers():
    x = [(i * 0x9E3779B97F4A7C15) & ((1 << 42) - 1) for i in range(4096)]
    s = ["".join("ACGT"[v >> 2 * j & 3] for j in range(21)) for v in x]
    codes, off = K.sequences(pa.array(s))
    fwd, rev = K.packed(codes, 21)
    assert fwd[off[:-1]].tolist() == x and rev[off[:-1]].tolist() == [scalar.code(scalar.rc(t)) for t in s]


def test_native_sketch_paths_agree():
    for s in SEQS + ["GATTACA" * 30, SEQS[8] + "AAAA" + scalar.rc(SEQS[8])]:
        for w, k in ((10, 15), (5, 8), (3, 4), (1, 5)):
            assert K.native_sketch(s, w, k) == K._stepwise_sketch(s, w, k, False)
    a = {(e[0], e[3]) for e in K.native_sketch(SEQS[9], 10, 15)}
    b = {(e[0], 1 - e[3]) for e in K.native_sketch(scalar.rc(SEQS[9]), 10, 15)}
    assert a == b
    s = "ACGTCATG" * 12
    doubled = "".join(c * 2 for c in s)
    assert [e[0] for e in K.native_sketch(s, 5, 11)] == [e[0] for e in K.native_sketch(doubled, 5, 11, True)]
    assert K.native_sketch("ACGANA", 3, 4) and K.native_sketch("", 3, 4) == []


def test_native_seeds_in_blocks_of_any_size(spark):
    r = random.Random(12)
    seqs = ["".join(r.choices("ACGT", k=n)) for n in (1, 11, 19, 20, 700)]
    seqs += ["", "".join(r.choices("ACGTNu", [9, 9, 9, 9, 1, 1], k=900)), "N" * 50 + seqs[4][:200] + "N" * 300 + seqs[4][:12], "GATTACA" * 60, seqs[4][:60] + "NNN", "A" * 90, seqs[4][:100] + "N" + seqs[4][:14]]
    df = spark.createDataFrame([*enumerate(seqs), (99, None)], "seq_id long, seq string")
    for w, k in ((10, 15), (1, 5), (19, 19)):
        want = sorted((i, *e) for i, s in enumerate(seqs) for e in K._stepwise_sketch(s, w, k, False))
        for block, spread in ((w, False), (23, True), (64, False), (1 << 20, True)):
            got = sorted((x.seq_id, x.key, x.span, x.pos, x.strand) for x in sketch.native_seeds(df, k, w, block=block, spread=spread).collect())
            assert got == want, (w, k, block)
    whole = sketch.native_seeds(df, 14, 5)
    assert sorted(tuple(x) for x in whole.collect()) == sorted((i, *e) for i, s in enumerate(seqs) for e in K.native_sketch(s, 5, 14))
    with pytest.raises(ValueError):
        sketch.native_seeds(df, 15, 10, block=9)


def test_dust_masks_repeats():
    left, right = ("".join(random.Random(seed).choices("ACGT", k=100)) for seed in (1, 2))
    found = K.dust(left + "A" * 60 + right)
    assert len(found) == 1 and found[0][0] in range(95, 103) and found[0][1] in range(157, 166)
    assert K.dust("ACGT") == [] and K.dust("") == []


def test_halo_blocks_lose_and_double_nothing(spark):
    rows = [(i, s) for i, s in enumerate(SEQS)]
    df = spark.createDataFrame(rows, "seq_id long, seq string")
    whole = {(r.seq_id, r.pos) for r in sketch.syncmers(df, 31, 11).collect()}
    blocks = sketch.halo_blocks(df, 128, 31)
    b = blocks.selectExpr("seq_id * 1000000 + start as seq_id", "seq_id as own", "start", "own_from", "own_to", "seq")
    hits = sketch.syncmers(b, 31, 11).join(b.drop("seq"), "seq_id").selectExpr("own", "start + pos as pos", "own_from", "own_to").filter("pos >= own_from and pos < own_to")
    got = [(r.own, r.pos) for r in hits.collect()]
    assert len(got) == len(set(got)) and set(got) == whole


def test_block_compat_leaves_out_last_block():
    codes, off = K.sequences(pa.array([SEQS[9]]))
    at, _ = K.minimizer_places(codes, off, 15, 11, block=128)
    full, _ = K.minimizer_places(codes, off, 15, 11)
    assert set(at) <= set(full) and max(at) < (1500 // 128) * 128 + 11


@pytest.mark.parametrize("kind,k", [("minimizer", 15), ("syncmer", 31)])
@pytest.mark.parametrize("size", [1, 14, 128, 129, 5000])
def test_chunks_of_any_size_and_order(kind, k, size):
    s = SEQS[9]
    chunks = [(i, s[i : i + size]) for i in range(0, len(s), size)]
    random.Random(size).shuffle(chunks)
    state, got = (0, "", -1, {}), []
    for i in range(0, len(chunks), 7):
        state, hits = advance(state, chunks[i : i + 7], kind, k, 11, 11)
        got += hits
    want = [p for p, _ in scalar.minimizers(s, 15, 11)] if kind == "minimizer" else scalar.syncmers(s, 31, 11)
    assert [p for p, _ in got] == want


def test_stream_equals_batch(spark, tmp_path):
    s = SEQS[9]
    for n in range(3):
        rows = [(7, o, s[o : o + 100]) for o in range(n * 500, (n + 1) * 500, 100)]
        spark.createDataFrame(rows, "seq_id long, offset long, chunk string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    from strandline.streaming.sketch_stream import sketch_files

    q = (sketch_files(spark, str(tmp_path / "in"), 1).writeStream.format("memory").queryName("hits").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = sorted(r.pos for r in spark.table("hits").collect())
    assert got == [p for p, _ in scalar.minimizers(s, 15, 11)]
