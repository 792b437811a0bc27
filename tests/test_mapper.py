import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandline.operators import alignment as A
from strandline.operators import chaining as C
from strandline.plans import mapper
from strandline.plans.options import PRESETS, Options, preset, with_max_intron
from strandline.sinks import formats

rng = random.Random(9)
DNA = st.text("ACGT", max_size=14)


def gap(n, s, dual):
    one = s.gap_open + s.gap_extend * n
    return min(one, s.gap_open2 + s.gap_extend2 * n) if dual else one


def plain_score(q, t, s, dual, local=False):
    """All gap lengths tried at each cell."""
    m = s.matrix()
    idx = {"A": 0, "C": 1, "G": 2, "T": 3}
    h = [[-10**9] * (len(t) + 1) for _ in range(len(q) + 1)]
    h[0][0] = 0
    best = 0
    for i in range(len(q) + 1):
        for j in range(len(t) + 1):
            x = [h[i][j]] if (i, j) == (0, 0) else []
            if i and j:
                x.append(h[i - 1][j - 1] + int(m[idx[q[i - 1]], idx[t[j - 1]]]))
            x += [h[i - n][j] - gap(n, s, dual) for n in range(1, i + 1)]
            x += [h[i][j - n] - gap(n, s, dual) for n in range(1, j + 1)]
            if local:
                x.append(0)
            h[i][j] = max(x)
            best = max(best, h[i][j])
    return best if local else h[len(q)][len(t)]


def cigar_score(c, q, t, s, dual):
    i = j = total = 0
    for op, n in c:
        if op == "M":
            total += sum(s.match if q[i + k] == t[j + k] else -s.mismatch for k in range(n))
            i, j = i + n, j + n
        elif op == "I":
            total, i = total - gap(n, s, dual), i + n
        else:
            total, j = total - gap(n, s, dual), j + n
    assert (i, j) == (len(q), len(t))
    return total


@settings(max_examples=60, deadline=None)
@given(DNA, DNA, st.booleans())
def test_global_alignment_is_optimal(q, t, dual):
    s = A.Scoring(gap_open=3, gap_extend=2, gap_open2=8, gap_extend2=1)
    a = A.align(q, t, s, dual=dual)
    assert a.score == plain_score(q, t, s, dual)
    assert cigar_score(a.cigar, q, t, s, dual) == a.score
    assert A.local_score(q, t, s) == plain_score(q, t, s, False, True)


def test_extension_stops_where_it_falls():
    same = "".join(rng.choice("ACGT") for _ in range(60))
    q, t = same + "A" * 200, same + "C" * 200
    a = A.align(q, t, mode="extend", zdrop=30, band=10)
    assert (a.query_end, a.target_end, a.dropped) == (60, 60, True) and a.score == 120 and A.text(a.cigar) == "60M"


def test_chain_is_extended_to_the_ends():
    r = random.Random(4)
    t = "".join(r.choice("ACGT") for _ in range(4000))
    q = t[100:1800] + t[1805:3900]
    got = A.align_chain(q, t, [(1500, 1600, 15)])
    assert (got["qs"], got["qe"], got["rs"], got["re"], A.text(got["cigar"])) == (0, len(q), 100, 3900, "1700M5D2095M")


def test_rows_computed_again_give_the_same(monkeypatch):
    r = random.Random(5)
    for mode, band in (("global", -1), ("global", 30), ("extend", 25), ("local", -1)):
        t = "".join(r.choice("ACGT") for _ in range(150))
        q = t[:40] + t[52:90] + "ACGT" * 3 + t[90:]
        want = A.align(q, t, mode=mode, band=band)
        monkeypatch.setattr(A, "CELLS", 100)
        assert A.align(q, t, mode=mode, band=band) == want and want.score > 0
        monkeypatch.undo()


def test_neighbours_are_aligned_whole(spark, tmp_path):
    from strandline.plans import kernel_queries

    r = random.Random(6)
    t = "".join(r.choice("ACGT") for _ in range(900))
    spark.createDataFrame([(1, t), (2, t[:700] + t[710:])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    row, = kernel_queries.QUERIES["align_affine"](spark, str(tmp_path)).collect()
    assert (row.seq_id, sum(n for op, n in A.parse(row.cigar) if op == "M"), sum(n for op, n in A.parse(row.cigar) if op == "I")) == (1, 890, 10)


def test_intron():
    left, right = "ACGATCGATTACGGATCTAC", "TTGACCATGGCATCAGGTTA"
    intron = "GTAAGT" + "".join(rng.choice("ACGT") for _ in range(80)) + "TTTCAG"
    t = left + intron + right
    d, a = A.splice_site_costs(t)
    got = A.align(left + right, t, A.Scoring(gap_open2=20), spliced=True, donor=d, acceptor=a)
    assert A.text(got.cigar) == f"20M{len(intron)}N20M"
    assert d[20] == 0 and a[20 + len(intron)] == 0


def test_cigar_tools():
    q, t = "ACGTTTGA", "ACGTTTTGA"
    c = A.left_aligned([("M", 6), ("D", 1), ("M", 2)], q, t)
    assert A.text(c) == "3M1D5M"
    assert A.md_tag(c, q, t) == "3^T5" and A.cs_tag(c, q, t) == ":3-t:5"
    assert A.text(A.expanded([("M", 4)], "ACGT", "ACCT")) == "2=1X1="
    assert A.parse("3M1D5M") == c and A.cs_tag([("M", 4)], "ACGT", "ACCT", True) == "=AC*cg=T"
    s = A.summary([("M", 4), ("I", 2), ("M", 2)], "ACGTAAGG", "ACCTGG")
    assert (s["mlen"], s["blen"], s["nm"], s["gaps"], s["gap_bases"]) == (5, 8, 3, 1, 2)
    assert A.cs_tag([("M", 2), ("N", 6), ("M", 2)], "ACGT", "ACgtccagGT") == ":2~gt6ag:2"
    assert A.drops([("M", 40)], "A" * 20 + "C" * 20, "A" * 40, 30) == (20, 20)
    assert A.inverted(A.reverse_complement("ACGATTACAGATTACAGGAT"), "ACGATTACAGATTACAGGAT")


def test_jump_over_a_known_junction():
    exon, intron, rest = "ACGTACGG", "GT" + "T" * 40 + "AG", "CATGCATGCAAGGTT"
    t = exon + intron + rest
    off, off2 = len(exon) + len(intron), len(exon)
    q = exon[-5:] + rest
    assert A.extend_over_junction(q, t, 5, off, [(off, off2)]) == (5, len(intron), 0)
    assert A.extend_over_junction("AAAAA" + rest, t, 5, off, [(off, off2)]) is None


def plain_chain(q, t, span, o):
    f = []
    for i in range(len(q)):
        best = span[i]
        for j in range(i):
            dq, dr = q[i] - q[j], t[i] - t[j]
            if dq <= 0 or dr <= 0 or dq > o.max_dist_x or dr > o.max_dist_x or dq > o.max_dist_y or abs(dr - dq) > o.bw:
                continue
            g, dd = min(dq, dr), abs(dr - dq)
            sc = min(span[j], g)
            if dd or g > span[j]:
                sc -= int(o.gap * dd + o.skip * g + 0.5 * (np.log2(dd + 1) if dd else 0))
            best = max(best, f[j] + sc)
        f.append(best)
    return f


def test_chain_scores():
    n = 120
    t = np.sort(np.array([rng.randrange(3000) for _ in range(n)]))
    q = np.array([max(0, int(x) + rng.randrange(-30, 30)) for x in t])
    span = np.full(n, 15)
    o = C.ChainOptions(min_cnt=2, min_score=20)
    f, before = C.best_scores(q, t, span, np.zeros(n, int), o)
    assert f.tolist() == plain_chain(q.tolist(), t.tolist(), span.tolist(), o)
    walks = C.backtrack(f, before, o)
    used = [x for _, w in walks for x in w]
    assert len(used) == len(set(used))
    for _, w in walks:
        assert all(t[a] < t[b] and q[a] < q[b] for a, b in zip(w, w[1:]))


def test_gap_limits():
    assert C.gap_limits(False, False, 5000, -1, 0, 100) == (5000, 5000)
    assert C.gap_limits(True, True, 100, -1, 800, 150) == (150, 650)


def test_options():
    for name in PRESETS:
        preset(name)
    assert preset("map-hifi").k == 19 and preset("sr", k=17).k == 17 and preset("asm20").w == 10
    assert with_max_intron(preset("splice"), 999).bw_long == 999
    for bad in (dict(bw=9, bw_long=1), dict(k=0), dict(best_n=-1), dict(pri_ratio=2.0), dict(gap_open=0), dict(gap_open2=1), dict(ambiguous=4), dict(zdrop=1), dict(rmq=True, spliced=True),
                dict(forward_only=True, reverse_only=True), dict(no_secondary=True, all_chains=True), dict(query_strand=True, output_sam=True), dict(split_index=True, output_tags=True), dict(gap_open=60, gap_open2=70)):
        with pytest.raises(ValueError):
            Options(**bad)
    with pytest.warns(UserWarning):
        Options(best_n=0)
    with pytest.raises(ValueError):
        preset("nothing")


@pytest.fixture(scope="module")
def mapped(spark):
    genome = "".join(rng.choice("ACGT") for _ in range(6000))
    other = "".join(rng.choice("ACGT") for _ in range(3000))
    a = genome[1000:1800]
    b = A.reverse_complement(genome[3000:3400] + "TT" + genome[3400:3700])
    c = list(other[500:1100])
    c[300] = "A" if c[300] != "A" else "C"
    del c[400:403]
    reads = spark.createDataFrame([(0, "a", a), (1, "b", b), (2, "c", "".join(c)), (3, "none", "ACGT" * 30)], "rid long, name string, seq string")
    refs = spark.createDataFrame([(0, "g", genome), (1, "o", other)], "rid long, name string, seq string")
    return reads, refs, mapper.map_reads(reads, refs, "map-ont").cache()


def test_reads_map_where_they_come_from(mapped):
    got = {r.qname: r for r in mapped[2].filter("primary").collect()}
    assert set(got) == {"a", "b", "c"}
    a, b, c = got["a"], got["b"], got["c"]
    assert (a.tname, a.rev, a.rs, a.re, a.qs, a.qe, a.cigar, a.nm, a.md) == ("g", 0, 1000, 1800, 0, 800, "800M", 0, "800")
    assert (b.tname, b.rev, b.rs, b.re, b.qs, b.qe, b.nm) == ("g", 1, 3000, 3700, 0, 702, 2) and A.parse(b.cigar)[1] == ("I", 2)
    assert (c.tname, c.rs, c.re, c.nm) == ("o", 500, 1100, 4) and any(op == "D" and n == 3 for op, n in A.parse(c.cigar))
    assert all(r.mapq == 60 for r in got.values())


def test_text_output(spark, mapped):
    reads, refs, m = mapped
    lines = {r.value.split("\t")[0]: r.value.split("\t") for r in formats.paf(m, {"cg": ("Z", "cigar")}).collect()}
    assert lines["a"][:12] == ["a", "800", "0", "800", "+", "g", "6000", "1000", "1800", "800", "800", "60"] and lines["a"][12:] == ["tp:A:P", "cg:Z:800M"]
    q = reads.selectExpr("name as qname", "seq", "cast(null as string) as qual")
    sam = {r.qname: r.value.split("\t") for r in formats.sam(m.selectExpr("*", "0 as seg").join(q, "qname")).collect()}
    assert sam["a"][1:6] == ["0", "g", "1001", "60", "800M"] and sam["b"][1] == "16" and sam["b"][9] == A.reverse_complement(reads.filter("name = 'b'").first().seq)
    head = [r.value for r in formats.sam_header(spark, refs.selectExpr("rid", "name", "length(seq) as len"), "@RG\\tID:x").orderBy("ord").collect()]
    assert head[1] == "@SQ\tSN:g\tLN:6000" and head[3] == "@RG\tID:x" and len(head) == 5
    with pytest.raises(ValueError):
        formats.sam_header(spark, refs, "ID:x")


def test_junction_lines(spark):
    seq = "AAAA" + "GT" + "C" * 10 + "AG" + "TTTT"
    m = spark.createDataFrame([("r", "c", 0, 0, "4M14N4M")], "qname string, tname string, rev int, rs long, cigar string")
    refs = spark.createDataFrame([("c", seq)], "name string, seq string")
    assert [r.value for r in formats.junctions(m, refs).collect()] == ["c\t4\t18\tr\t6\t+"]


def test_long_gap_chaining_joins_what_the_band_splits(spark):
    rows = [(0, 0, 0, t, t, 15) for t in range(100, 1000, 20)] + [(0, 0, 0, t + 4000, t, 15) for t in range(1000, 2000, 20)]
    a = spark.createDataFrame(rows, "qid long, tid long, rev int, tpos long, qpos long, span int")
    o = C.ChainOptions(bw=500, gap=0.01)
    assert C.chains(a, o).select("chain").distinct().count() == 2
    assert C.chains(a, o, long_gaps=True).select("chain").distinct().count() == 1


def test_parents(spark):
    rows = [(0, 1, 0, 100, 90, 9), (0, 2, 10, 100, 80, 9), (0, 3, 95, 200, 70, 7)]
    df = spark.createDataFrame(rows, "qid long, rank long, qs long, qe long, score long, cnt long")
    got = {r["rank"]: (r.parent, r.subsc, r.n_sub) for r in C.parents(df).collect()}
    assert got == {1: (1, 80, 1), 2: (1, 0, 0), 3: (3, 0, 0)}
    few = df.withColumn("cnt", C.F.when(C.F.col("rank") == 1, 9).otherwise(3).cast("long"))
    assert {r["rank"]: r.n_sub for r in C.parents(few).collect()} == {1: 0, 2: 0, 3: 0}  # scores of chains alone make no rival
    near = few.withColumns({"dp_max": C.F.lit(100) - C.F.col("rank") * 4, "tid": C.F.col("rank"), "rs": C.F.lit(0), "re": C.F.lit(9)})
    assert {r["rank"]: (r.n_sub, r.dp_max2) for r in C.parents(near).collect()} == {1: (1, 92), 2: (0, 0), 3: (0, 0)}


def test_regions_tools(spark):
    from strandline.operators import regions as R

    a = spark.createDataFrame([(0, 0, t, t, 15) for t in (10, 30, 50, 900, 930)], "qid long, chain long, tpos long, qpos long, span int")
    cuts = spark.createDataFrame([(0, 0, 3)], "qid long, chain long, at int")
    assert [r.part for r in R.split_at(a, cuts).orderBy("tpos").collect()] == [0, 0, 0, 1, 1]
    one = spark.createDataFrame([(0, 0, 5, 0, 50, 1)], "qid long, tid long, rs long, rev int, score long, hash long")
    two = spark.createDataFrame([(0, 0, 9, 0, 70, 2)], one.schema)
    got = R.merged_parts([one, two], [0, 10]).orderBy("rank").collect()
    assert [(r.tid, r.rank) for r in got] == [(10, 1), (0, 2)]
    # neighbours are primaries by their place on the target, whatever their place on the query; the last two rows are no neighbours
    inv = spark.createDataFrame([(0, 0, 100, 1, True, 40, False), (0, 0, 200, 2, True, 0, True), (0, 0, 300, 3, True, 20, False), (0, 0, 210, 4, False, 0, False), (1, 0, 9, 1, True, 30, False), (1, 0, 50, 2, True, 0, True)],
                                "qid long, tid long, rs long, rank long, primary boolean, mapq int, inv boolean")
    assert [r.mapq for r in R.inversion_mapq(inv).orderBy("qid", "rank").collect()] == [40, 20, 20, 0, 30, 0]
    rows = [(0, 1, 1, 100, 0.01, False), (0, 2, 1, 90, 0.2, True), (0, 3, 1, 10, 0.005, True), (0, 4, 2, 5, 0.0, False)]
    r = spark.createDataFrame(rows, "qid long, rank long, parent long, score long, div double, strand_retained boolean")
    left = R.strand_filter(r)
    assert sorted(x["rank"] for x in left.collect()) == [1, 3, 4]
    assert sorted((x["rank"], x.parent) for x in R.renumbered(left).collect()) == [(1, 1), (2, 1), (3, 3)]
    assert [x.sam_pri for x in R.sam_primary(R.renumbered(left)).orderBy("rank").collect()] == [True, False, False]


def test_command_line(spark, tmp_path, capsys):
    from strandline.__main__ import main

    genome = "".join(rng.choice("ACGT") for _ in range(3000))
    (tmp_path / "r.fa").write_text(f">g\n{genome}\n")
    (tmp_path / "q.fq").write_text(f"@q\n{genome[500:900]}\n+\n{'I' * 400}\n")
    main(["scan", str(tmp_path / "r.fa")])
    assert "bases=3000" in capsys.readouterr().out
    main(["map", str(tmp_path / "r.fa"), str(tmp_path / "q.fq"), str(tmp_path / "out"), "-x", "map-ont"])
    lines = [r.value.split("\t") for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert [x[:9] for x in lines] == [["q", "400", "0", "400", "+", "g", "3000", "500", "900"]]
    main(["map", str(tmp_path / "r.fa"), str(tmp_path / "q.fq"), str(tmp_path / "sam"), "-a"])
    assert spark.read.text(str(tmp_path / "sam" / "records")).first().value.startswith("q\t0\tg\t501\t60\t400M")


def test_single_intron():
    left, right = "ACGATCGATTACGGATCTAC", "TTGACCATGGCATCAGGTTA"
    intron = "GTAAGT" + "C" * 60 + "TTTCAG"
    s = A.Scoring(gap_open2=20)
    t = left + intron + right
    got = A.single_intron(left + right, t, s)
    d, a = A.splice_site_costs(t)
    whole = A.align(left + right, t, s, spliced=True, donor=d, acceptor=a)
    assert A.text(got.cigar) == "20M72N20M" == A.text(whole.cigar) and got.score == whole.score
    assert A.single_intron("A" * 40, t, s) is None and A.single_intron(left, left, s) is None
