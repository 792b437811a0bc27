"""Range joins on regions: against plain definitions on odd rows, and by the rows that their joins make."""

import random

from strandline.operators import intervals


def _tables(spark):
    rng = random.Random(3)
    regions = [(i % 40 if i % 17 else None, f"chr{i % 3}", st := rng.randrange(6000), st + rng.choice([0, 1, 300, 5000])) for i in range(60)]
    introns = [(f"chr{rng.randrange(4)}", st := rng.randrange(6000), st + rng.choice([-40, 0, 1, 60, 900]), rng.choice(["+", "-", None])) for _ in range(400)] * 2
    return (regions, introns, spark.createDataFrame(regions, "region_id long, chrom string, st long, en long"), spark.createDataFrame(introns, "chrom string, st long, en long, strand string"))


def test_splice_signals_of_repeated_and_turned_introns(spark):
    regions, introns, r, i = _tables(spark)
    want = {}
    for rid, chrom, st, en in regions:
        for c, a, b, strand in introns:
            if c == chrom and st <= a < en and b <= en:
                for pos, bit in ((a - st, 1 if strand == "+" else 8), (b - 1 - st, 2 if strand == "+" else 4)):
                    want[rid, pos] = want.get((rid, pos), 0) | bit
    rows = intervals.annotate_splice_signals(r, i).collect()
    assert len(rows) == len(want) and {(x.region_id, x.pos): x.bits for x in rows} == want


def test_best_scores_of_repeated_places(spark):
    regions, _, r, _ = _tables(spark)
    rng = random.Random(4)
    scores = [(f"chr{rng.randrange(4)}", rng.randrange(9000), rng.choice([None, *range(-9, 9)])) for _ in range(900)] * 3
    want = {}
    for rid, chrom, st, en in regions:
        for c, p, x in scores:
            if c == chrom and st <= p < en:
                old = want.get((rid, p - st))
                want[rid, p - st] = x if old is None else old if x is None else max(old, x)
    rows = intervals.best_splice_scores(r, spark.createDataFrame(scores, "chrom string, pos long, score int")).collect()
    assert len(rows) == len(want) and {(x.region_id, x.pos): x.score for x in rows} == want


def test_places_of_regions_meet_scores_once(spark):
    """Rows that regions meet are bounded by places, however often scores and introns come."""
    r = spark.range(50).selectExpr("id AS region_id", "'c' AS chrom", "0L AS st", "100L AS en")
    s = spark.range(20000).selectExpr("'c' AS chrom", "id % 10 AS pos", "cast(id % 7 as int) AS score")
    i = spark.range(20000).selectExpr("'c' AS chrom", "id % 10 AS st", "id % 10 + 20 AS en", "'+' AS strand")
    for df, n in ((intervals.best_splice_scores(r, s), 500), (intervals.annotate_splice_signals(r, i), 1000)):
        assert df.count() == n
        df.collect()
        assert _most_joined(df) <= 50 * 25


def _most_joined(df) -> int:
    """The largest number of rows that a join of the plan gave."""
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(p.plan())
        elif "Join" in name and p.metrics().contains("numOutputRows"):
            most = max(most, p.metrics().apply("numOutputRows").value())
        todo += [p.children().apply(k) for k in range(p.children().size())]
    return most
