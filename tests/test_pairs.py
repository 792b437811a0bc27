"""Short reads and pairs, summaries of alignments, range-maximum chaining: against plain forms and planted places."""

import math
import random
import time

import numpy as np
import pytest

from strandline.operators import alignment as A
from strandline.operators import chaining as C
from strandline.operators import regions as R
from strandline.plans import mapper
from strandline.plans.options import preset

rng = random.Random(31)


def dna(n):
    return "".join(rng.choices("ACGT", k=n))


def frame(spark, rows):
    return spark.createDataFrame([(i, n, s) for i, (n, s) in enumerate(rows)], "rid long, name string, seq string")


def mates(spark, rows):
    return spark.createDataFrame([(f, s, f"p{f}", x) for f, pair in enumerate(rows) for s, x in enumerate(pair)], "frag_id long, seg int, name string, seq string")


COPY = dna(150)
GENOME = dna(3000) + COPY + dna(6000) + COPY + dna(2000)  # copies at 3000 and 9150
FREQUENT = dna(160)
MANY = "".join(dna(400) + FREQUENT for _ in range(12)) + dna(400)


@pytest.fixture(scope="module")
def indexed(spark):
    return mapper.build_index(frame(spark, [("g", GENOME), ("m", MANY)]), "sr")


def test_two_equal_places_leave_no_quality(indexed, spark):
    got = mapper.map_reads(frame(spark, [("r", COPY), ("u", GENOME[500:650])]), indexed).cache()
    r = [x for x in got.collect() if x.qname == "r"]
    assert sorted(x.rs for x in r) == [3000, 9150] and max(x.mapq for x in r) <= 3 and sum(x.primary for x in r) == 1
    assert [x.dp_max2 > 0 for x in r if x.primary] == [True]
    assert [(x.rs, x.mapq) for x in got.collect() if x.qname == "u"] == [(500, 60)]
    written = mapper.written(got, indexed.options)  # only what is written goes without secondaries
    assert sorted(x.qname for x in written.collect()) == ["r", "u"]
    assert mapper.written(got, preset("map-ont")).count() == 3


def test_mates_place_each_other(indexed, spark):
    turned = A.reverse_complement
    rows = [
        (COPY, turned(GENOME[3300:3450])),  # the first in a repeat, the second unique behind it
        (GENOME[8900:9050], turned(COPY)),  # the second in a repeat
        (GENOME[500:650], turned(GENOME[750:900])),
        (GENOME[500:650], turned(GENOME[6000:6150])),  # too far apart
    ]
    m = mapper.map_pairs(mates(spark, rows), indexed).cache()
    best = {(x.frag, x.seg): x for x in m.collect() if x.primary}
    assert [(best[f, 0].rs, best[f, 1].rs) for f in range(4)] == [(3000, 3300), (8900, 9150), (500, 750), (500, 6000)]
    assert [(best[f, 0].rev, best[f, 1].rev) for f in range(4)] == [(0, 1)] * 4
    assert [best[f, 0].proper and best[f, 1].proper for f in range(4)] == [True, True, True, False]
    assert all((x.qs, x.qe, x.cigar) == (0, 150, "150M") for x in best.values())
    assert best[0, 0].mapq > 3 and best[2, 0].mapq == 60


def test_chains_of_fragments_are_split_by_mate(spark):
    places = [{"tpos": 1000 + k, "qpos": k, "span": 15} for k in (20, 60, 130, 140, 155, 260)]
    schema = "qid long, tid long, rev int, chain long, score long, cnt long, qs long, qe long, rs long, re long, mlen long, blen long, first long, second long, places array<struct<tpos:long,qpos:long,span:int>>"
    for rev in (0, 1):
        df = spark.createDataFrame([(7, 0, rev, 0, 90, 6, 0, 0, 0, 0, 0, 0, 150, 120, places)], schema)
        got = {r.qid: r for r in R.split_fragments(df).collect()}
        begin = {14: 120 if rev else 0, 15: 0 if rev else 150}
        size = {14: 150, 15: 120}
        for qid, r in got.items():
            mine = [p for p in places if begin[qid] <= p["qpos"] < begin[qid] + size[qid]]
            at = [p["qpos"] - begin[qid] for p in mine]
            assert [(p.tpos, p.qpos) for p in r.places] == [(p["tpos"], x) for p, x in zip(mine, at)] and r.cnt == len(mine)
            a, b = at[0] - 14, at[-1] + 1
            assert (r.qs, r.qe) == ((size[qid] - b, size[qid] - a) if rev else (a, b))
            steps = list(zip(at, at[1:]))
            assert r.mlen == 15 + sum(min(15, y - x) for x, y in steps) and r.blen == 15 + sum(y - x for x, y in steps)


def test_second_look_up_for_reads_of_frequent_seeds(spark):
    refs, reads = frame(spark, [("m", MANY)]), frame(spark, [("r", FREQUENT[5:155]), ("u", MANY[100:250])])
    few = preset("sr", mid_occ=3, max_occ=0, best_n=20)
    x = mapper.build_index(refs, few)
    assert {r.qname for r in mapper.map_reads(reads, x).collect()} == {"u"}
    more = mapper.map_reads(reads, x, preset("sr", mid_occ=3, max_occ=20, best_n=20)).collect()
    at = sorted(r.rs for r in more if r.qname == "r")
    assert at == [400 + 560 * k + 5 for k in range(12)] and max(r.mapq for r in more if r.qname == "r") <= 3
    assert [(r.rs, r.mapq) for r in more if r.qname == "u"] == [(100, 60)]


def test_options_given_with_an_index(indexed, spark):
    reads = frame(spark, [("u", GENOME[500:650])])
    assert mapper.map_reads(reads, indexed, preset("sr", min_dp_max=10**6)).count() == 0
    with pytest.raises(ValueError):
        mapper.map_reads(reads, indexed, preset("sr", k=15))


def plain_summary(cigar, q, t, s, log_gaps):
    """Letter by letter."""
    purine, i, j = {"A": 0, "G": 0, "C": 1, "T": 1}, 0, 0
    run = best = 0.0
    known = same = unknown = opened = gap = 0
    for op, n in cigar:
        if op in "ID":
            text = q[i : i + n] if op == "I" else t[j : j + n]
            unknown += text.count("N")
            known += n - text.count("N")
            run = max(0.0, run - s.gap_open - s.gap_extend * (math.log2(1 + n) if log_gaps else 1))
            opened, gap = opened + 1, gap + n
        else:
            for a, b in zip(q[i : i + n], t[j : j + n]):
                if "N" in (a, b):
                    run, unknown = run - s.ambiguous, unknown + 1
                else:
                    run += s.match if a == b else -s.transition if s.transition and purine[a] == purine[b] else -s.mismatch
                    known, same = known + 1, same + (a == b)
                run = max(0.0, run)
                best = max(best, run)
        i, j = i + n * (op != "D"), j + n * (op != "I")
    return {"blen": known, "mlen": same, "n_ambi": unknown, "nm": known - same + unknown, "gaps": opened, "gap_bases": gap, "dp_max": int(best + 0.499), "event_identity": same / (known + unknown - gap + opened)}


@pytest.mark.parametrize("log_gaps", [True, False])
def test_summaries_letter_by_letter(log_gaps):
    r = random.Random(8)
    for _ in range(300):
        s = A.Scoring(match=r.choice([1, 2]), mismatch=r.choice([4, 8]), transition=r.choice([0, 1, 3]), gap_open=r.choice([4, 12]), gap_extend=r.choice([1, 2]))
        cigar = [("M" if k % 2 == 0 else r.choice("ID"), r.randrange(1, 12)) for k in range(r.choice([1, 3, 7]))]
        q = "".join(r.choices("ACGTN", (8, 8, 8, 8, 1), k=sum(n for op, n in cigar if op != "D")))
        t, i = "", 0
        for op, n in cigar:
            t += "" if op == "I" else "".join(r.choices("ACGTN", (8, 8, 8, 8, 1), k=n)) if op == "D" else "".join(c if r.random() < 0.8 else r.choice("ACGTN") for c in q[i : i + n])
            i += n * (op != "D")
        got = A.summary(cigar, q, t, s, log_gaps)
        want = plain_summary(cigar, q, t, s, log_gaps)
        assert {k: got[k] for k in want} == pytest.approx(want)
    four = A.summary([("M", 15), ("D", 4), ("M", 15)], "A" * 30, "A" * 34)
    assert four["dp_max"] == 51


def test_parents_carry_what_was_met_and_discount_alternates(spark):
    rows = [(0, 1, 0, 100, 90, 9, False, 70, 2), (0, 2, 10, 100, 80, 3, True, 0, 0)]
    df = spark.createDataFrame(rows, "qid long, rank long, qs long, qe long, score long, cnt long, is_alt boolean, subsc long, n_sub long")
    got = {r["rank"]: (r.parent, r.subsc, r.n_sub) for r in C.parents(df, alt_drop=0.5).collect()}
    assert got == {1: (1, 70, 2), 2: (1, 0, 0)}  # 80 counts as 40
    assert {r["rank"]: r.subsc for r in C.parents(df.drop("is_alt")).collect()} == {1: 80, 2: 0}


def test_range_maxima_equal_all_pairs():
    r = np.random.default_rng(1)
    for trial in range(80):
        n = int(r.integers(1, 300))
        t = np.sort(r.integers(0, r.choice([300, 3000, 100000]), n))
        q = np.maximum(0, t + r.integers(-200, 200, n)) if trial % 2 else r.integers(0, 3000, n)
        by = np.lexsort((q, t))
        q, t, span = q[by], t[by], r.integers(10, 20, n)
        o = C.ChainOptions(max_dist_x=int(r.choice([400, 5000, 100000])), gap=float(r.choice([0.01, 0.12, 1.0])), skip=float(r.choice([0, 0.05])), spliced=bool(trial % 3 == 0))
        all_pairs = C.ChainOptions(o.max_dist_x, o.max_dist_x, o.max_dist_x, 10**9, gap=o.gap, skip=o.skip, spliced=o.spliced)
        f, before = C.best_scores_by_range(q, t, span, o)
        g, _ = C.best_scores(q, t, span, np.zeros(n, int), all_pairs)
        assert f.tolist() == g.tolist()
        assert all(b < 0 or q[b] < q[i] and t[b] < t[i] for i, b in enumerate(before))


def test_range_maxima_on_many_anchors():
    t = np.arange(0, 600_000, 10)
    q = t + np.where(t > 300_000, 7000, 0)
    began = time.process_time()
    f, _ = C.best_scores_by_range(q, t, np.full(len(t), 19), C.ChainOptions(max_dist_x=100_000, gap=0.152))
    assert f[-1] > 19 * 0.5 * len(t) and time.process_time() - began < 30


def test_end_bonus_reaches_the_end():
    same = dna(60)
    q, t = same + "AC", same + "AG"
    s = A.Scoring(mismatch=8, gap_open=12)
    wild = A.align(q, t, s, "extend", band=10)
    assert (wild.query_end, A.text(wild.cigar)) == (61, "61M")
    whole = A.align(q, t, s, "extend", band=10, end_bonus=10)
    assert (whole.query_end, A.text(whole.cigar), whole.score) == (62, "62M", 114)
    assert A.align(same + "ACCCC", same + "AGGGG", s, "extend", band=10, end_bonus=10).query_end == 61


def test_junctions_at_borders_of_blocks(spark):
    from strandline.sinks import formats

    for lead in range(1, 9):
        seq = "A" * lead + "GT" + "C" * 10 + "AG" + "TTTT"
        m = spark.createDataFrame([("r", "c", 0, 0, f"{lead}M14N4M")], "qname string, tname string, rev int, rs long, cigar string")
        refs = spark.createDataFrame([("c", seq)], "name string, seq string")
        assert [r.value for r in formats.junctions(m, refs, 4).collect()] == [f"c\t{lead}\t{lead + 14}\tr\t6\t+"]


def test_sam_has_the_tags_of_alignments(indexed, spark):
    from strandline.sinks import formats

    reads = frame(spark, [("u", GENOME[500:650])])
    m = mapper.map_reads(reads, indexed).withColumn("seg", C.F.lit(0)).join(reads.selectExpr("name as qname", "seq", "cast(null as string) as qual"), "qname")
    line, = [r.value.split("\t") for r in formats.sam(m).collect()]
    assert line[:6] == ["u", "0", "g", "501", "60", "150M"] and {"NM:i:0", "ms:i:300", "AS:i:300", "nn:i:0", "tp:A:P", "de:f:0", "rl:i:0"} <= set(line[11:])


@pytest.mark.parametrize("size", [300, 400])
def test_inversions_that_fall_less_than_zdrop(spark, size):
    r = random.Random(size)
    genome = "".join(r.choices("ACGT", k=9000))
    read = genome[1000:4000] + A.reverse_complement(genome[4000 : 4000 + size]) + genome[4000 + size : 7400]
    got = mapper.map_reads(frame(spark, [("r", read), ("plain", genome[1000:7400])]), frame(spark, [("g", genome)]), "map-ont").collect()
    inv = [x for x in got if x.inv]
    assert len(inv) == 1 and inv[0].rev == 1 and abs(inv[0].rs - 4000) < 20 and abs(inv[0].re - 4000 - size) < 20
    both = sorted((x.rs, x.re) for x in got if x.qname == "r" and not x.inv and x.primary)
    assert len(both) == 2 and both[0][0] == 1000 and abs(both[0][1] - 4000) < 20 and abs(both[1][0] - 4000 - size) < 20 and both[1][1] == 7400
    assert [(x.rs, x.re, x.inv) for x in got if x.qname == "plain"] == [(1000, 7400, False)]


def test_deepest_drop_by_steps():
    r = random.Random(4)
    s = A.Scoring()
    for _ in range(200):
        cigar = [("M" if k % 2 == 0 else r.choice("ID"), r.randrange(1, 15)) for k in range(r.choice([1, 3, 5]))]
        q = "".join(r.choices("ACGT", k=sum(n for op, n in cigar if op != "D")))
        t, i = "", 0
        for op, n in cigar:
            t += "" if op == "I" else "".join(r.choices("ACGT", k=n)) if op == "D" else "".join(c if r.random() < 0.7 else r.choice("ACGT") for c in q[i : i + n])
            i += n * (op != "D")
        i = j = score = best = most = 0
        at = (0, 0)
        for op, n in cigar:
            for k in range(n if op == "M" else 1):
                if op == "M":
                    score += s.match if q[i] == t[j] else -s.mismatch
                    i, j = i + 1, j + 1
                else:
                    score -= s.gap_open + s.gap_extend * n
                    i, j = i + n * (op == "I"), j + n * (op == "D")
                if score >= best:
                    best, at = score, (i, j)
                most = max(most, best - score - abs((i - at[0]) - (j - at[1])) * s.gap_extend)
        assert A.deepest_drop(cigar, q, t, s)[0] == most
