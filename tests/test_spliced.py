"""Spliced alignment with known junctions, splice scores and jumps: against plain forms and planted reads."""

import random

import numpy as np
import pytest

from strandline.operators import alignment as A

rng = random.Random(77)
S = A.Scoring(1, 2, 1, 0, 2, 1, 32, 0)


def dna(n):
    return "".join(rng.choices("ACGT", k=n))


def plain_spliced(q, t, s, donor, acceptor, extend=False):
    """The best score by three states a cell and every begin of an intron: matches and what ends in a gap; gap or intron next."""
    n, m = len(q), len(t)
    no = float("-inf")
    h = [[no] * (m + 1) for _ in range(n + 1)]
    d = [[no] * (m + 1) for _ in range(n + 1)]
    i_ = [[no] * (m + 1) for _ in range(n + 1)]
    for i in range(n + 1):
        for j in range(m + 1):
            best = 0 if i == j == 0 else no
            if i and j:
                best = max(best, h[i - 1][j - 1] + (s.match if q[i - 1] == t[j - 1] else -s.mismatch))
            if i:
                i_[i][j] = max(h[i - 1][j] - s.gap_open, i_[i - 1][j]) - s.gap_extend
            if j:
                d[i][j] = max(h[i][j - 1] - s.gap_open, d[i][j - 1]) - s.gap_extend
            best = max(best, i_[i][j], d[i][j])
            for k in range(j):  # introns do not touch each other
                if without[i, k] > no:
                    best = max(best, without[i, k] - s.gap_open2 - donor[k] - acceptor[j]) if k < j else best
            own = max(0 if i == j == 0 else no, h[i - 1][j - 1] + (s.match if q[i - 1] == t[j - 1] else -s.mismatch) if i and j else no, i_[i][j], d[i][j])
            without[i, j] = own
            h[i][j] = best
    return max(max(r) for r in h) if extend else h[n][m]


without: dict = {}


def score_of(cigar, q, t, s, donor, acceptor):
    i = j = total = 0
    for op, n in cigar:
        if op == "M":
            total += sum(s.match if a == b else -s.mismatch for a, b in zip(q[i : i + n], t[j : j + n]))
            i, j = i + n, j + n
        elif op == "N":
            total -= s.gap_open2 + donor[j] + acceptor[j + n]
            j += n
        else:
            total -= s.gap_open + s.gap_extend * n
            i, j = (i + n, j) if op == "I" else (i, j + n)
    return total


@pytest.mark.parametrize("mode", ["global", "extend"])
def test_spliced_optimum(mode):
    r = random.Random(5)
    s = A.Scoring(2, 4, 1, 0, 3, 1, 9, 0)
    introns = 0
    for _ in range(150):
        left, mid, right = ("".join(r.choices("ACGT", k=r.randint(1, 9))) for _ in range(3))
        t = left + mid + "".join(r.choices("ACGT", k=r.randint(0, 20))) + right
        q = left + right if r.random() < 0.7 else left + mid[1:] + right
        donor, acceptor = (np.array([r.choice([-6, -3, 0, 3, 8]) for _ in range(len(t) + 1)]) for _ in range(2))
        without.clear()
        want = plain_spliced(q, t, s, donor, acceptor, mode == "extend")
        got = A.align(q, t, s, mode, spliced=True, donor=donor, acceptor=acceptor)
        assert got.score == max(want, 0) if mode == "extend" else got.score == want
        assert score_of(got.cigar, q, t, s, donor, acceptor) == got.score
        introns += any(op == "N" for op, _ in got.cigar)
    assert introns > 40


def test_site_costs_by_definition():
    t = dna(400)
    for reverse in (False, True):
        donor, acceptor = A.splice_site_costs(t, reverse)
        for i in range(len(t) + 1):
            two, after, ended, before = t[i : i + 2], t[i + 2 : i + 3], t[i - 2 : i] if i > 1 else "", t[i - 3 : i - 2] if i > 2 else ""
            first = {"CT": 3, "GT": 7} if reverse else {"GT": 3, "GC": 5, "AT": 7}
            last = {"AC": 3, "GC": 5, "AT": 7} if reverse else {"AG": 3, "AC": 7}
            want = first.get(two, 10)
            assert donor[i] == (0 if want == 3 and after in ("A", "G") else want)
            want = last.get(ended, 10)
            assert acceptor[i] == (0 if want == 3 and before in ("C", "T") else want)
    assert A.plain_site_cost(9) == {"full": 0, "core": 4, "gc": 9, "at": 9, "none": 9}
    assert [len(x) for x in A.splice_site_costs("")] == [1, 1]


def test_sites_of_known_introns_and_scores():
    t = dna(60)
    plain = A.splice_sites(t)
    known = A.splice_sites(t, introns=[(10, 40, "+"), (10, 50, "+"), (12, 30, "-"), (3, 70, "+")], bonus=9)
    d, a = known.part(5, 55)
    d0, a0 = plain.part(5, 55)
    assert {i + 5: x for i, x in enumerate(d0 - d) if x} == {10: 9} and {i + 5: x for i, x in enumerate(a0 - a) if x} == {40: 9, 50: 9}
    d, a = known.part(5, 45)
    assert {i + 5: x for i, x in enumerate(plain.part(5, 45)[1] - a) if x} == {40: 9}
    assert np.array_equal(known.part(11, 60)[0], plain.part(11, 60)[0])  # introns that are not whole
    turned = A.splice_sites(t, True, introns=[(12, 30, "-"), (10, 40, "+")], bonus=9)
    assert np.flatnonzero(turned.part(0, 60)[0] != A.splice_sites(t, True).part(0, 60)[0]).tolist() == [12]
    scored = A.splice_sites(t, scores=[(10, "+", False, 7), (10, "+", False, 3), (40, "+", True, 5), (41, "-", True, 5), (20, "+", False, 4), (20, "+", True, 4)], penalty=5, introns=[(10, 40, "+")], bonus=9)
    d, a = scored.part(0, 60)
    assert {i: x for i, x in enumerate(d - plain.donor) if x != 5} == {10: -7} and {i: x for i, x in enumerate(a - plain.acceptor) if x != 5} == {40: -5, 20: -4}
    d, a = A.splice_sites(t, True, scores=[(41, "-", True, 5)], penalty=5).part(0, 60)
    assert np.flatnonzero(d - A.splice_sites(t, True).donor != 5).tolist() == [41]


def test_a_known_junction_wins_over_a_slightly_better_one():
    exon, other = dna(30), dna(30)
    # the same read by an intron with the usual sites, and by one three bases on without them
    t = exon + "GTAAGT" + dna(80) + "TTTCAG" + other
    shifted = exon + t[30:33]
    q = shifted + t[30 + 92 + 3 :]
    if q[30:33] != t[30 + 92 : 30 + 95]:
        t = t[: 30 + 92] + q[30:33] + t[30 + 95 :]
    places = [(14, 14, 15), (len(q) - 1, len(t) - 1, 15)]
    plain = A.align_chain(q, t, places, S, spliced=True)
    assert plain["cigar"] == [("M", 30), ("N", 92), ("M", 30)]
    known = A.align_chain(q, t, places, S, spliced=True, sites=A.splice_sites(t, introns=[(33, 125, "+")], bonus=11))
    assert known["cigar"] == [("M", 33), ("N", 92), ("M", 27)]


def test_ends_of_spliced_reads_go_over_introns():
    left, mid, right = dna(40), dna(100), dna(40)
    one, two = ("GTAAGT" + dna(20) + "TTTCAG" for _ in range(2))
    t = dna(50) + left + one + mid + two + right + dna(50)
    q = left + mid + right
    at = 50 + 40 + 32
    got = A.align_chain(q, t, [(k, at + k - 40, 15) for k in (60, 80, 100, 120)], S, band=300001, zdrop=200, spliced=True, reach=2000, end_bonus=-1)
    assert got["cigar"] == [("M", 40), ("N", 32), ("M", 100), ("N", 32), ("M", 40)] and (got["qs"], got["qe"], got["rs"]) == (0, 180, 50)
    assert A.end_reach(10, 2000, S) == 18 and A.end_reach(1, 2000, S) == 1 and A.end_reach(5000, 2000, S) == 2000


LEFT, RIGHT = dna(295) + "TCACT", "CACCTG" + dna(294)  # unlike the ends of the intron
INTRON = "GTAAGT" + dna(500) + "TTTCAG"
HEAD = dna(200)
GENE = HEAD + LEFT + INTRON + RIGHT + dna(200)  # the intron lies at 500..1012
ST, EN = 500, 500 + len(INTRON)


@pytest.fixture(scope="module")
def gene(spark):
    from strandline.plans import mapper

    return mapper.build_index(spark.createDataFrame([(0, "g", GENE), (1, "turned", A.reverse_complement(GENE))], "rid long, name string, seq string"), "splice")


def mapped(spark, gene, reads, known=None):
    from strandline.plans import mapper

    frame = spark.createDataFrame([(i, f"r{i}", x) for i, x in enumerate(reads)], "rid long, name string, seq string")
    rows = mapper.map_reads(frame, gene, known=known).collect()
    return {(x.qid, x.tname): x for x in rows}


def agrees(x, read):
    """Whether a row's coordinates, alignment and tags fit its read and target."""
    target = (GENE if x.tname == "g" else A.reverse_complement(GENE))[x.rs : x.re]
    q = A.reverse_complement(read[x.qs : x.qe]) if x.rev else read[x.qs : x.qe]
    c = A.parse(x.cigar)
    assert sum(n for op, n in c if op in "MI") == len(q) and sum(n for op, n in c if op in "MDN") == len(target)
    assert (x.cs, x.md) == (A.cs_tag(c, q, target), A.md_tag(c, q, target)) and x.mlen == A.summary(c, q, target)["mlen"]


def test_reads_jump_over_known_introns(spark, gene):
    from strandline.plans import mapper

    jumps = spark.createDataFrame([("g", ST, EN, 1), ("g", EN, ST, 1), ("g", EN, ST, 2), ("other", EN, ST, 1)], "chrom string, off long, off2 long, flag int")
    read_left = LEFT[-5:] + RIGHT[:200]  # five bases of the exon before
    read_right = LEFT[-200:] + RIGHT[:6]
    wrong = "".join("ACGT"[("ACGT".index(c) + 1) % 4] for c in LEFT[-5:]) + RIGHT[:200]
    reads = [read_left, A.reverse_complement(read_left), read_right, A.reverse_complement(read_right), wrong, RIGHT[20:220]]
    plain = mapped(spark, gene, reads)
    assert not any("N" in x.cigar for x in plain.values())
    got = mapped(spark, gene, reads, mapper.Known(jumps=jumps))
    for i in (0, 1):
        x = got[i, "g"]
        assert (x.rs, x.re, x.qs, x.qe, x.cigar) == (ST - 5, EN + 200, 0, 205, f"5M{EN - ST}N200M") and x.rev == i
    for i in (2, 3):
        x = got[i, "g"]
        assert (x.rs, x.re, x.qs, x.qe, x.cigar) == (ST - 200, EN + 6, 0, 206, f"200M{EN - ST}N6M") and x.rev == i - 2
    assert "N" not in got[4, "g"].cigar and got[5, "g"].cigar == "200M" and not any("N" in x.cigar for (_, name), x in got.items() if name != "g")
    for (i, _), x in got.items():
        agrees(x, reads[i])
    assert got[0, "g"].dp_max == plain[0, "g"].dp_max + plain[0, "g"].qs * S.match + A.strand_bonus(S)


def test_jumps_that_are_not_alone(spark, gene):
    from strandline.plans import mapper

    # another begin of the intron with the same two bases before it
    other = GENE.find(LEFT[-2:], 60)
    known = lambda rows: mapper.Known(jumps=spark.createDataFrame(rows, "chrom string, off long, off2 long, flag int"))
    short = LEFT[-2:] + RIGHT[:200]
    long = LEFT[-5:] + RIGHT[:200]
    got = mapped(spark, gene, [short, long], known([("g", EN, ST, 1), ("g", EN, other + 2, 1)]))
    assert 30 < other < ST - 20 and "N" not in got[0, "g"].cigar  # fewer than three bases, and two places
    assert got[1, "g"].cigar == f"5M{EN - ST}N200M"  # five bases tell them apart


def test_known_introns_and_scores_reach_the_alignment(spark):
    from strandline.plans import mapper
    from strandline.plans.options import preset

    # an intron without the usual sites: three bases on lies one that has a better acceptor
    exon, other = dna(150), dna(150)
    inner = "CCAAGT" + dna(300) + "TTCCTC"
    text = dna(100) + exon + inner + other + dna(100)
    st, en = 250, 250 + len(inner)
    frame = lambda rows: spark.createDataFrame(rows, "rid long, name string, seq string")
    x = mapper.build_index(frame([(0, "t", text)]), preset("splice"))
    read = frame([(0, "r", exon + other)])
    introns = spark.createDataFrame([("t", st, en, "+"), ("t", st, len(text) + 9, "+"), ("u", st, en, "+")], "chrom string, st long, en long, strand string")
    known = mapper.map_reads(read, x, known=mapper.Known(introns=introns)).first()
    assert (known.cigar, known.trans) == (f"150M{len(inner)}N150M", "+")
    scores = spark.createDataFrame([(0, 1, st, "D", 20), (0, 1, en, "A", 20), (0, -1, st + 3, "A", 20)], "rid long, strand int, pos long, type string, score int")
    scored = mapper.map_reads(read, x, known=mapper.Known(introns=introns, scores=scores)).first()
    plain = mapper.map_reads(read, x).first()
    assert scored.cigar == known.cigar and scored.dp_score - plain.dp_score >= 30 and known.dp_score - plain.dp_score <= 18
    turned = mapper.map_reads(frame([(0, "r", A.reverse_complement(exon + other))]), x, known=mapper.Known(introns=introns)).first()
    assert (turned.cigar, turned.trans, turned.rev) == (known.cigar, "-", 1)


def test_command_line_takes_known_introns(spark, tmp_path):
    from strandline.__main__ import main

    (tmp_path / "g.fa").write_text(f">g\n{GENE}\n")
    (tmp_path / "r.fa").write_text(f">r\n{LEFT[-5:] + RIGHT[:200]}\n")
    (tmp_path / "i.bed").write_text(f"g\t{ST - 50}\t{EN + 50}\tx\t1\t+\t0\t0\t0\t2\t50,50,\t0,{EN - ST + 50},\n")
    (tmp_path / "s.txt").write_text(f"g\t{ST}\t+\tD\t20\ng\t{EN}\t+\tA\t20\n")
    main(["map", str(tmp_path / "g.fa"), str(tmp_path / "r.fa"), str(tmp_path / "out"), "-x", "splice", "--jumps", str(tmp_path / "i.bed"), "--introns", str(tmp_path / "i.bed"), "--splice-scores", str(tmp_path / "s.txt")])
    line = spark.read.text(str(tmp_path / "out")).first().value.split("\t")
    assert line[:4] == ["r", "205", "0", "205"] and f"cg:Z:5M{EN - ST}N200M" in line


def test_query_of_spliced_reads(spark):
    """Items without their middle third: each that finds its own item over an intron does so over the known one."""
    from strandline.plans import kernel_queries

    d = "/root/testdata/sf0.001"
    n = {x.name: len(x.seq) for x in kernel_queries._records(spark, d, "benchmark", "item_id", "item").collect()}
    rows = kernel_queries.QUERIES["spliced_known"](spark, d).collect()
    assert len({(x.qname, x.rank) for x in rows}) == len(rows)
    own = [x for x in rows if x.qname == x.tname and x.rev == 0 and "N" in x.cigar]
    assert len(own) >= 10
    for x in own:
        third = n[x.qname] // 3
        assert (x.cigar, x.rs, x.re, x.trans) == (f"{third}M{third}N{x.qlen - third}M", 0, n[x.qname], "+")
