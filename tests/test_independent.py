"""Operators against plain definitions written from what they are, not from how they are computed."""

import io
import itertools
import math
import random

import numpy as np
import pytest

from strandline.functions import kernels as K
from strandline.functions.register import register
from strandline.operators import alignment as A
from strandline.operators import chaining as C
from strandline.operators import regions as R
from strandline.plans import mapper
from strandline.plans.options import preset
from strandline.sinks import formats
from strandline.sources import records, synthetic
from strandline.streaming import record_stream
from tests import scalar

rng = random.Random(77)


def dna(n, letters="ACGT"):
    return "".join(rng.choices(letters, k=n))


# ------------------------------------------------------------------ sketch and masks

def plain_sketch(seq, w, k):
    """Every k-mer that is least in one of the windows of w k-mers that have a strand."""
    kmers = []
    for i in range(len(seq) - k + 1):
        f, r = seq[i : i + k], scalar.rc(seq[i : i + k])
        if f != r:
            num = lambda s: int("".join(str("ACGT".index(c)) for c in s), 4)
            kmers.append((scalar.masked_hash(min(num(f), num(r)), k), i + k - 1, int(num(f) > num(r))))
    out = set()
    for i in range(len(kmers) - w + 1):
        part = kmers[i : i + w]
        least = min(part)[0]
        out |= {x for x in part if x[0] == least}
    if kmers and len(kmers) < w:
        out.add(max((x for x in kmers if x[0] == min(kmers)[0]), key=lambda x: x[1]))
    return sorted((pos, key, z) for key, pos, z in out)


@pytest.mark.parametrize("w, k", [(5, 7), (10, 15), (3, 4), (1, 5)])
def test_native_sketch_is_the_least_of_windows(w, k):
    for letters in ("ACGT", "AAAC", "AT"):
        for n in (k, k + w - 2, k + w - 1, 60, 200):
            s = dna(n, letters)
            got = sorted((pos, key, z) for key, span, pos, z in K.native_sketch(s, w, k))
            if letters == "ACGT" or n >= k + w + 10:
                assert got == plain_sketch(s, w, k), s


def plain_dust(seq, threshold, window):
    """Stretches of triplets that score over the threshold while no part of them scores more, joined."""
    t = [seq[i : i + 3] for i in range(len(seq) - 2)]

    def score(a, b):
        n = b - a + 1
        counts = [t[a : b + 1].count(x) for x in set(t[a : b + 1])]
        return sum(c * (c - 1) / 2 for c in counts) / (n - 1) if n > 1 else 0.0

    spans = {(a, b): score(a, b) for a in range(len(t)) for b in range(a + 1, min(len(t), a + window - 2))}
    good = []
    for (a, b), s in spans.items():
        if s * 10 > threshold and all(spans.get((x, y), 0) <= s for x in range(a, b) for y in range(x + 1, b + 1)):
            good.append((a, b + 3))
    out = []
    for a, b in sorted(good):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def test_dust_is_the_union_of_perfect_stretches():
    for _ in range(40):
        s = dna(rng.randint(5, 20)) + dna(1) * rng.randint(0, 14) + dna(6) + dna(2) * rng.randint(0, 8) + dna(rng.randint(0, 10))
        assert K.dust(s, 20, 24) == plain_dust(s, 20, 24), s


# ------------------------------------------------------------------ chaining

def plain_link(i, j, o):
    """What the later anchor i = (q, t, span, seg) adds behind j; None if they cannot be linked."""
    dq, dr, same = i[0] - j[0], i[1] - j[1], i[3] == j[3]
    d, near = abs(dr - dq), min(dr, dq)
    if dq <= 0 or dq > o.max_dist_x or same and (dr == 0 or dq > o.max_dist_y or d > o.bw or o.segments > 1 and not o.spliced and dr > o.max_dist_y):
        return None
    gain = min(j[2], near)
    if not same and dr == 0:
        return gain + 1
    if d or near > j[2]:
        line, log = o.gap * d + o.skip * near, math.log2(d + 1) if d else 0.0
        gain -= int(min(line, log) if not same or o.spliced and dr > dq else line + 0.5 * log)
    return gain


@pytest.mark.parametrize("spliced, segments", [(False, 1), (False, 2), (True, 1)])
def test_chain_scores_of_several_segments(spliced, segments):
    o = C.ChainOptions(max_dist_x=400, max_dist_y=300, bw=80, gap=0.12, spliced=spliced, segments=segments)
    for _ in range(30):
        a = sorted({(rng.randrange(300), rng.randrange(500), 15, rng.randrange(segments)) for _ in range(40)}, key=lambda x: (x[1], x[0]))
        q, t, span, seg = (np.array([x[k] for x in a]) for k in range(4))
        best = []
        for i, x in enumerate(a):
            best.append(max([x[2], *[best[j] + s for j in range(i) if x[1] - a[j][1] <= o.max_dist_x and (s := plain_link(x, a[j], o)) is not None]]))
        f, before = C.best_scores(q, t, span, seg, o)
        assert f.tolist() == best
        if segments == 1:  # without a band, all anchors in reach
            wide = C.ChainOptions(max_dist_x=400, max_dist_y=400, bw=400, gap=0.12, spliced=spliced)
            g, _ = C.best_scores_by_range(q, t, span, o)
            h, _ = C.best_scores(q, t, span, seg, wide)
            assert g.tolist() == h.tolist()
        seen = set()
        for _, walk in C.backtrack(f, before, C.ChainOptions(min_cnt=1, min_score=10)):
            assert not seen & set(walk)
            seen |= set(walk)


def test_groups_cross_batches(spark):
    """Chains do not depend on how anchors come in batches."""
    rows = [(i % 3, i % 2, i % 5 % 2, 10 * i + rng.randrange(5), 10 * i, 15) for i in range(600)]
    df = spark.createDataFrame(rows, "qid long, tid long, rev int, tpos long, qpos long, span int")
    want = sorted(map(tuple, C.chains(df, C.ChainOptions(min_cnt=2, min_score=20)).collect()))
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert want and sorted(map(tuple, C.chains(df, C.ChainOptions(min_cnt=2, min_score=20)).collect())) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


# ------------------------------------------------------------------ quality

def plain_mapq(rows, least, match, short):
    total = sum(r["score"] for r in rows if r["primary"])
    out = {}
    for r in rows:
        if not r["primary"]:
            out[r["rank"]] = 0
            continue
        pen = min((1.0 if r["score"] > 100 else 0.01 * r["score"]) * total / (total + r["rep_len"]), 1.0 if r["cnt"] > 10 else 0.1 * r["cnt"])
        identity, sub = r["mlen"] / r["blen"], max(r["subsc"], least) / r["score0"]
        base = identity * pen * 40.0 * math.log(r["dp_max"] / match)
        if r["dp_max2"] > 0:
            x = r["dp_max2"] / r["dp_max"] * sub
            q = math.floor(base * (1 - x * x))
            if not short:
                q = min(q, math.floor(6.02 * identity**2 * (r["dp_max"] - r["dp_max2"]) / match + 0.499))
        else:
            q = math.floor(base * (1 - sub))
        q = min(60, max(0, q - math.floor(4.343 * math.log(r["n_sub"] + 1) + 0.499)))
        out[r["rank"]] = 1 if q == 0 and r["dp_max"] > r["dp_max2"] else q
    return out


@pytest.mark.parametrize("short", [False, True])
def test_quality_of_aligned_hits(spark, short):
    rows = []
    for q in range(40):
        n = rng.randint(1, 4)
        for k in range(1, n + 1):
            dp = rng.randint(50, 900)
            score = rng.randint(40, 400)
            rows.append(dict(qid=q, rank=k, primary=k == 1 or rng.random() < 0.3, qs=k * 10, score=score, score0=score, cnt=rng.randint(2, 30), subsc=rng.randint(0, score), n_sub=rng.randint(0, 5), rep_len=rng.choice([0, 50]),
                             mlen=rng.randint(300, 400), blen=rng.randint(400, 450), dp_max=dp, dp_max2=rng.choice([0, dp, dp // 2, dp - 1]), inv=False))
    df = spark.createDataFrame(rows, "qid long, rank long, primary boolean, qs long, score long, score0 long, cnt long, subsc long, n_sub long, rep_len long, mlen long, blen long, dp_max long, dp_max2 long, inv boolean")
    got = {(r.qid, r["rank"]): r.mapq for r in R.mapq_aligned(df, 40, 2, short).collect()}
    for q, group in itertools.groupby(rows, key=lambda r: r["qid"]):
        want = plain_mapq(list(group), 40, 2, short)
        assert {k: v for (i, k), v in got.items() if i == q} == want


def test_copies_and_other_strands_among_secondaries(spark):
    cols = "qid long, rank long, parent long, score long, tid long, rev int, qs long, qe long, rs long, re long"
    rows = [(0, 1, 1, 100, 5, 0, 0, 90, 10, 100), (0, 2, 1, 99, 5, 0, 0, 90, 10, 100), (0, 3, 1, 95, 6, 0, 0, 90, 10, 100), (0, 4, 1, 50, 7, 1, 0, 90, 10, 100), (0, 5, 1, 20, 7, 1, 0, 90, 10, 100)]
    got = {r["rank"]: r.strand_retained for r in R.top_secondaries(spark.createDataFrame(rows, cols), 0.8, 2, 5, 40).collect()}
    assert got == {1: False, 3: False, 4: True}


# ------------------------------------------------------------------ mapper

@pytest.fixture(scope="module")
def genome():
    return dna(9000)


def frame(spark, rows):
    return spark.createDataFrame([(i, n, s) for i, (n, s) in enumerate(rows)], "rid long, name string, seq string")


def key(rows):
    return sorted((r.qname, r.tname, r.rev, r.qs, r.qe, r.rs, r.re, r.cigar, r.mapq, r.primary) for r in rows)


def test_index_saved_split_and_windows(spark, tmp_path, genome):
    """A saved index, an index in parts and small blocks of references all map as one index in memory does."""
    other = dna(4000)
    refs = frame(spark, [("a", genome), ("b", other), ("c", genome[2000:5000] + dna(500))])
    reads = frame(spark, [("x", genome[2500:3300]), ("y", A.reverse_complement(other[100:900])), ("z", genome[7000:7500] + dna(40))])
    o = preset("map-ont")
    want = key(mapper.map_reads(reads, refs, o).collect())
    assert {w[0] for w in want} == {"x", "y", "z"} and all(w[8] < 10 for w in want if w[0] == "x") and all(w[8] > 30 for w in want if w[0] != "x" and w[9])
    mapper.save_index(mapper.build_index(refs, o), str(tmp_path / "i"))
    assert key(mapper.map_reads(reads, mapper.load_index(spark, str(tmp_path / "i"))).collect()) == want
    with pytest.raises(ValueError):
        mapper.load_index(spark, str(tmp_path / "i"), preset(k=11))
    parts = mapper.index_parts(refs, 9000, o)
    assert len(parts) == 2 and key(mapper.merged_parts(reads, parts).collect()) == want
    need = spark.createDataFrame([(1, 0, 100, 1300), (2, 0, 0, 9000), (3, 1, 3990, 4000), (4, 2, 255, 256)], "row long, tid long, w0 long, w1 long")
    seqs = {0: genome, 1: other, 2: refs.filter("rid = 2").first().seq}
    got = {r.row: r.target for r in mapper.target_windows(need, refs, 256).collect()}
    assert got == {r.row: seqs[r.tid][r.w0 : r.w1] for r in need.collect()}


def test_ends_splits_and_inversions(spark, genome):
    bad = list(genome[2000:2600])
    for i in range(0, 600, 12):
        bad[i] = "ACGT"["ACGT".index(bad[i]) ^ 1]
    reads = [("ends", genome[1000:2000] + "".join(bad)), ("turned", genome[3000:3900] + A.reverse_complement(genome[3900:4150]) + genome[4150:5000])]
    got = mapper.map_reads(frame(spark, reads), frame(spark, [("g", genome)]), preset("map-ont", min_dp_max=80, zdrop=150, zdrop_inv=100)).collect()
    a = [r for r in got if r.qname == "ends"]
    assert [(r.qs, r.qe, r.rs, r.re) for r in a] == [(0, 1600, 1000, 2600)] or a[0].qe >= 1585  # not cut after 300 bases
    b = sorted((r.rev, r.inv, r.rs, r.re) for r in got if r.qname == "turned")
    assert any(rev == 1 and abs(rs - 3900) < 25 and abs(re - 4150) < 25 for rev, _, rs, re in b)
    assert min(rs for *_, rs, _ in b) == 3000 and max(re for *_, re in b) == 5000


def test_pairs(spark, genome):
    def mates(at, size=500, n=120):
        return genome[at : at + n], A.reverse_complement(genome[at + size - n : at + size])
    rows = [("p", *mates(1000)), ("q", *mates(6000)), ("far", genome[200:320], A.reverse_complement(genome[8000:8120])), ("half", genome[5000:5120], dna(120))]
    first, second = (frame(spark, [(f"{n}/{k + 1}", s[k]) for n, *s in rows]).withColumn("qual", C.F.lit(None).cast("string")) for k in (0, 1))
    both = records.read_paired(first, second)
    got = mapper.map_pairs(both, frame(spark, [("g", genome)]), "sr").filter("primary").collect()
    by = {(r.qname, r.seg): r for r in got}
    for n, at in (("p", 1000), ("q", 6000)):
        assert by[n, 0].proper and by[n, 1].proper and by[n, 0].rs == at and by[n, 1].re == at + 500 and by[n, 1].rev == 1
    assert not by["far", 0].proper and not by["half", 0].proper and ("half", 1) not in by
    q = both.withColumn("qid", C.F.col("frag_id") * 2 + C.F.col("seg"))
    m = formats.with_unmapped(mapper.map_pairs(both, frame(spark, [("g", genome)]), "sr"), q.select("qid", C.F.col("name").alias("qname"), C.F.length("seq").cast("long").alias("qlen"), "seg"))
    m = m.withColumn("paired", C.F.lit(True)).withColumn("proper", C.F.coalesce("proper", C.F.lit(False)))
    lines = [r.value.split("\t") for r in formats.sam(m.join(q.select("qid", "seq", "qual"), "qid")).collect()]
    flags = {(x[0], bool(int(x[1]) & 0x80)): int(x[1]) for x in lines}
    assert len(lines) == 8 and flags["p", False] & 1 and flags["p", True] & 0x10 and flags["half", True] & 4 and flags["half", False] & 8


def test_marked_gaps():
    q, t = "ACGTTTTTACG", "ACGTTTACG"
    c = A.left_aligned([("M", 4), ("I", 2), ("M", 5)], q, t)
    assert A.cs_tag(c, q, t) == ":3+tt:6" and A.cs_tag(c, q, t, marked=True) == ":3+[tt]:6"
    assert A.cs_tag([("M", 3), ("D", 3), ("M", 3)], "AAACCC", "AAAGATCCC", marked=True) == ":3-gat:3"


def test_best_local():
    core = dna(60)
    got = A.best_local(dna(30, "AC") + core + dna(20, "GT"), dna(10, "GT") + core + dna(40, "AC"))
    assert got["dp_score"] == A.local_score(core, core) or got["dp_score"] >= 120
    assert got["qs"] <= 30 and got["qe"] >= 90 and got["dp_score"] >= 2 * 60


# ------------------------------------------------------------------ SQL names, made-up reads, streams

def test_sql_functions(spark):
    register(spark)
    s = dna(200)
    row = spark.sql(f"SELECT seq_revcomp('{s}') AS a, seq_slice('{s}', 5, 25, true) AS b, seq_hpc('AACCCGT') AS c, seq_name('x1 y z') AS d, seq_fragment('x/2') AS e, seq_hash32(123456789) AS f, seq_bases('aCxgN t') AS g").first()
    assert tuple(row) == (scalar.rc(s), scalar.rc(s[5:25]), "ACGT", "x1", "x", scalar.hash32(123456789), "ACGT")
    got = [tuple(r) for r in spark.sql(f"SELECT pos, hash FROM seq_minimizers('{s}', 15, 11) ORDER BY pos").collect()]
    assert got == scalar.minimizers(s, 15, 11)
    assert [r.pos for r in spark.sql(f"SELECT x.pos FROM (SELECT '{s}' AS seq) t, LATERAL seq_syncmers(t.seq, 21, 11) x ORDER BY pos").collect()] == scalar.syncmers(s, 21, 11)


def test_made_up_reads_come_back(spark, tmp_path):
    made = synthetic.reads(spark, 700, 50)
    rows = made.orderBy("rid").collect()
    assert len({r.seq for r in rows}) > 690 and {len(r.seq) for r in rows} == {50} and set("".join(r.seq for r in rows)) == set("ACGT")
    for mixed, marked in ((False, 0), (True, 20)):
        path = str(tmp_path / f"{mixed}.fq")
        synthetic.fastq_lines(made, mixed, marked).orderBy("value").write.text(path)
        got = {r.name: (r.seq, r.qual) for r in records.read_fastq(spark, path).collect()}
        assert got == {r.name: (r.seq, r.qual) for r in rows}


@pytest.mark.parametrize("kind", ["fasta", "fastq"])
def test_records_of_chunks_of_any_size_and_order(spark, kind):
    made = [(f"r{i}", "c c" if i % 3 else "", dna(rng.randint(1, 40))) for i in range(30)]
    text = "".join(f">{n} {c}\n{s[:10]}\r\n{s[10:]}\n" if kind == "fasta" else f"@{n} {c}\r\n{s}\n+\n{'I' * len(s)}\n" for n, c, s in made)
    for size in (1, 7, 100, 10_000):
        chunks = [(i, text[i : i + size], i + size >= len(text)) for i in range(0, len(text), size)]
        rng.shuffle(chunks)
        state, out = (0, 0, "", {}), []
        while chunks:
            few = [chunks.pop() for _ in range(min(len(chunks), rng.randint(1, 5)))]
            state, got = record_stream.advance(state, few, kind)
            out += got
        assert [(n, c, s) for _, n, c, s, _ in out] == made and [x[0] for x in out] == list(range(30))
    got = records.read_standard_input(spark, io.BytesIO(text.encode()), kind, 8).orderBy("rid").collect()
    assert [(r.name, r.comment, r.seq) for r in got] == made


def test_record_stream(spark, tmp_path):
    text = "".join(f">s{i}\n{dna(30)}\n" for i in range(20))
    for k, i in enumerate(range(0, len(text), 97)):
        (tmp_path / "in").mkdir(exist_ok=True)
        spark.createDataFrame([("f", i, text[i : i + 97], i + 97 >= len(text))], "file string, offset long, chunk string, last boolean").coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    src = spark.readStream.schema("file string, offset long, chunk string, last boolean").option("maxFilesPerTrigger", 3).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    run = record_stream.record_stream(src).writeStream.format("memory").queryName("parsed").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination(90)
    got = spark.table("parsed").orderBy("n").collect()
    assert [r.name for r in got] == [f"s{i}" for i in range(20)] and "".join(f">{r.name}\n{r.seq}\n" for r in got) == text
