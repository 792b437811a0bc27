"""Steps whose work or memory has to grow no faster than their input."""

import collections
import os
import random

import duckdb
import numpy as np
import pyarrow as pa

from strandline.functions import kernels as K
from strandline.functions.hashing import masked_hash, with_masked_hash
from strandline.operators import chaining, index, mating, seeding, sketch
from strandline.plans import registry
from tests.test_intervals import _most_joined


def _optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_kernels_get_few_letters_at_once():
    rng = random.Random(1)
    texts = [None if rng.random() < 0.1 else "A" * rng.choice([0, 1, 7, 40, 300]) for _ in range(500)]
    b = pa.RecordBatch.from_arrays([pa.array(range(500)), pa.array(texts)], ["seq_id", "seq"])
    pieces = list(sketch._few([b, b.slice(100, 50), b.slice(0, 0)], 256))
    assert [i for p in pieces for i in p.column(0).to_pylist()] == [*range(500), *range(100, 150)]
    assert [t for p in pieces for t in p.column(1).to_pylist()] == texts + texts[100:150]
    letters = [sum(len(t or "") for t in p.column(1).to_pylist()) for p in pieces]
    assert all(n <= 256 or p.num_rows == 1 for n, p in zip(letters, pieces))
    assert len(pieces) < 2 * sum(letters) / 256 + 4


def test_collisions_hash_different_kmers_once(spark):
    rng = np.random.default_rng(2)
    kmers = rng.integers(0, 4**7, 4000).tolist() + [0] * 500
    df = spark.createDataFrame([(k,) for k in kmers], "kmer long")
    out = index.collisions(df, 15)
    row = out.first()
    assert (row.raw_keys, row.hash_keys, row.seeds) == (len(set(kmers)), len(set(kmers)), len(kmers)) and 0 < row.mixed_keys <= row.raw_keys
    assert _optimized(out).count("shiftleft") + _optimized(out).count("<<") < 20
    both = with_masked_hash(df, "h", "kmer", 15)
    assert both.where(masked_hash(both.kmer, 15) != both.h).count() == 0
    none = index.collisions(df.limit(0), 15).first()
    assert tuple(none) == (0, 0, 0, 0)


def test_streaks_by_running_frames(spark):
    rng = random.Random(5)
    lengths = {i: rng.randrange(200, 900) for i in range(12)}
    hits = [(i, p, 15, rng.choice([1, 1, 3, 5, 9, 20])) for i in lengths for p in sorted(rng.sample(range(14, lengths[i]), 60))]
    want = {}
    for i, n in lengths.items():
        mine = [h for h in hits if h[0] == i]
        good = [h[1] for h in mine if h[3] <= 2]
        streaks = {}
        for _, p, _, c in mine:
            want[i, p] = c <= 2
            if c > 2:
                streaks.setdefault(sum(g <= p for g in good), []).append((c, p))
        for s, bad in streaks.items():
            begin, end = ([0, *good][s], [*good, n][s])
            for c, p in sorted(bad)[: min(128, int((end - begin) / 50 + 0.499))]:
                want[i, p] = c <= 10
    out = seeding.select_streaks(spark.createDataFrame(hits, "seq_id long, pos long, span int, n long"), spark.createDataFrame([*lengths.items()], "seq_id long, length long"), 2, 10, 50)
    rows = out.collect()
    assert len(rows) == len(hits) and {(r.seq_id, r.pos): r.kept for r in rows} == want
    assert "currentrow$(), unboundedfollowing" not in _optimized(out)


def test_pairing_meets_copies_once(spark, tmp_path):
    """Anchors of copies are made once; the result is that of the SQL over all documents."""
    rng = random.Random(6)
    texts = ["".join(rng.choices("ACGT", k=240)) for _ in range(4)]
    rows = [(100 - i, texts[i % 3] if i < 60 else "" if i < 70 else texts[3]) for i in range(71)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(os.path.join(tmp_path, "documents.parquet"))
    df = registry.QUERIES["pairing"](spark, str(tmp_path))
    got = df.select("qid", "tid", "rev", "rank1", "rank2", "score").collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(f"SELECT qid, tid, rev, rank1, rank2, score FROM ({registry.ORACLES['pairing']})").fetchall()
    assert len(want) == 61 and sorted(map(tuple, got)) == sorted(want)
    df.collect()
    assert _most_joined(df) < 3 * 20 * 20  # twenty copies of three texts, some forty seeds each


def test_pairing_makes_no_rows_of_anchors(spark, tmp_path, monkeypatch):
    """Near copies, which share most keys: rows that the plan joins do not grow with their pairs. Passages that come back, turned ones too, copies and short texts are there."""
    monkeypatch.setattr(mating, "BLOCK_SEEDS", 1000)
    rng = random.Random(9)
    turned = lambda t: t[::-1].translate(str.maketrans("ACGT", "TGCA"))
    base, line = "".join(rng.choices("ACGT", k=400)), "".join(rng.choices("ACGT", k=60))
    texts = []
    for i in range(60):
        at = rng.randrange(400)
        texts.append(base[:at] + rng.choice("ACGT") + base[at + 1 :])
    texts += [line * 4, line + base[:150] + line + turned(line), turned(base), base[100:330], line, "ACGT", None, texts[3], texts[3].lower()]
    for i in range(30):  # keys that a few have, so that the cut-off lies above the copies
        texts.append("".join(rng.choices("ACGT", k=900)))
    rows = [(i * 37 % 101 + 5, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(os.path.join(tmp_path, "documents.parquet"))
    df = registry.QUERIES["pairing"](spark, str(tmp_path))
    got = df.select("qid", "tid", "rev", "rank1", "rank2", "score").collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(f"SELECT qid, tid, rev, rank1, rank2, score FROM ({registry.ORACLES['pairing']})").fetchall()
    assert len(want) > 90 and sorted(map(tuple, got)) == sorted(want)
    df.collect()
    assert _most_joined(df) < 10 * len(texts)


def test_pairing_in_slices_as_at_once(monkeypatch):
    """Best pairs and regions before them do not depend on how many anchors a kernel holds, even if a query's own are too many."""
    r = np.random.RandomState(4)
    n = 12
    docs = pa.table({"seq_id": np.arange(n) * 3, "size": r.randint(1, 4, n), "length": np.full(n, 500)})
    docs = docs.append_column("members", pa.array([[int(i) * 3 + j for j in range(m)] for i, m in enumerate(docs["size"].to_pylist())], pa.list_(pa.int64())))
    rows = sorted({(int(d), int(p)) for d, p in zip(r.randint(0, n, 900), r.randint(14, 500, 900))})
    doc, pos = np.array(rows).T
    seeds = pa.table({"seq_id": doc * 3, "half": np.zeros(len(doc), np.int8), "key": r.randint(0, 60, len(doc)), "pos": pos, "strand": r.randint(0, 2, len(doc))})
    half = np.where(pos - 14 >= 250, 1, np.where(pos < 250, 0, -1))
    seeds = seeds.set_column(1, "half", pa.array(half.astype(np.int8)))
    packed = mating._pack([pa.scalar(0)], seeds, docs)
    block = mating.Block({c: packed.column(c)[0] for c in packed.column_names}, "")
    every = np.ones(n, bool)
    found = []
    for size, bits in ((1 << 17, 62), (300, 62), (7, 30), (300, 9)):
        monkeypatch.setattr(mating, "ANCHORS", size)
        monkeypatch.setattr(mating, "BITS", bits)
        regions = sorted(zip(*(np.concatenate(c).tolist() for c in zip(*mating.regions_of(block, block, 15, every)))))
        best = {}
        for x in zip(*(np.concatenate(c).tolist() for c in zip(*mating.best_pairs(block, block, 15, 5000)))):
            best[x[0]] = max(best.get(x[0], (-10**9,)), (x[1], x[2], -x[3], *x[4:]))
        q = np.array(sorted(best))
        _, _, tid, rev, m1, s1, m2, s2 = np.array([best[i] for i in q.tolist()]).T
        found.append((regions, best, mating.better(block, block, 15, q, -tid, rev, np.stack([m1, m2], 1), np.stack([s1, s2], 1)).tolist()))
    assert found[0] == found[1] == found[2] == found[3] and len(found[0][1]) == n
    want = collections.defaultdict(list)
    for i in range(len(doc)):
        q = 2 * doc[i] + half[i]
        for j in np.flatnonzero(seeds["key"].to_numpy() == seeds["key"][i].as_py()) if half[i] >= 0 else []:
            rev = int(seeds["strand"][i].as_py() != seeds["strand"][int(j)].as_py())
            place = int(pos[i]) - 250 * int(half[i])
            want[int(doc[i]), int(doc[j]), rev, int(half[i])].append((int(pos[j]), place if not rev else 250 - (place + 1 - 15) - 1))
    plain = []
    for g, a in want.items():
        a.sort()
        if len(a) > 1:
            plain.append((*g, 15 + sum(min(y[0] - x[0], y[1] - x[1], 15) for x, y in zip(a, a[1:])), a[0][0] - 14, a[-1][0] + 1))
    assert found[0][0] == sorted(plain)


def test_groups_are_scored_together_as_one_by_one():
    """Links and scores of many small groups in one array: those of each group by itself, ties too, with fillers behind short ones."""
    r = np.random.RandomState(8)
    for o in (chaining.ChainOptions(), chaining.ChainOptions(spliced=True, max_dist_x=300), chaining.ChainOptions(segments=2, bw=40, max_iter=3)):
        size = r.randint(1, 13, 200)
        place = np.minimum(np.arange(12), size[:, None] - 1)
        q, t, span = r.randint(0, 400, (200, 12)), np.sort(r.randint(0, 400, (200, 12)), axis=1), r.randint(9, 13, (200, 12))
        seg = r.randint(0, o.segments, (200, 12))
        row = np.arange(200)[:, None]
        f, before = chaining.best_scores_of_groups(*(x[row, place] for x in (q, t, span, seg)), o)
        for g, n in enumerate(size.tolist()):
            one, prev = chaining.best_scores(q[g, :n], t[g, :n], span[g, :n], seg[g, :n], o)
            assert (f[g, :n] == one).all() and (before[g, :n] == prev).all()


def test_small_groups_reach_the_backtrack_only_with_a_chain(spark):
    """A group that no chain good enough ends in costs no loop of its own; chains are those of groups taken one by one."""
    r = np.random.RandomState(3)
    rows = [(int(i % 7), int(i), 0, int(x), int(y), 11) for i in range(300) for x, y in zip(sorted(r.randint(0, 2000, 1 + i % 5)), r.randint(0, 2000, 1 + i % 5))]
    rows += [(1, 5000, 0, 100 + 12 * j, 50 + 12 * j, 11) for j in range(90)] + [(2, 5001, 1, 100 + 12 * j, 50 + 12 * j, 11) for j in range(9)]
    a = spark.createDataFrame(rows, "qid long, tid long, rev int, tpos long, qpos long, span int")
    o = chaining.ChainOptions(min_cnt=2, min_score=15)
    groups = collections.defaultdict(list)
    for qid, tid, rev, x, y, n in rows:
        groups[qid, tid, rev].append((x, y, n))
    want = []
    for key, g in groups.items():
        t, q, n = np.array(sorted(g)).T
        want += [(*key, int(s), len(w)) for s, w in chaining.backtrack(*chaining.best_scores(q, t, n, np.zeros(len(q), int), o), o)]
    got = chaining.chain_rows(a, o)
    assert sorted((x.qid, x.tid, x.rev, x.score, x.cnt) for x in got.collect()) == sorted(want) and want
    assert got.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_pieces_are_sketched_together_as_one_by_one():
    r = np.random.RandomState(2)
    texts = ["".join(r.choice(list("ACGTN"), n, p=[0.24, 0.24, 0.24, 0.24, 0.04])).encode() for n in r.randint(0, 90, 120)] + [b"", b"ACGTACGTACG", b"N" * 40]
    n = len(texts)
    low, high, ends = r.randint(0, 30, n), r.randint(20, 100, n), r.rand(n) < 0.7
    for w, k in ((5, 11), (10, 15), (1, 3), (60, 5)):
        key, piece, at, strand = K.block_sketches(texts, w, k, low, high, ends)
        for i, text in enumerate(texts):
            one = K.block_sketch(text, w, k, int(low[i]), int(high[i]), bool(ends[i]))
            mine = piece == i
            assert (key[mine] == one[0]).all() and (at[mine] == one[1]).all() and (strand[mine] == one[2]).all() and mine.sum() == len(one[0])
            if ends[i]:
                assert [(x[0], x[2], x[3]) for x in K._stepwise_sketch(text.decode(), w, k, False) if low[i] <= x[2] < high[i]] == list(zip(key[mine].tolist(), at[mine].tolist(), strand[mine].tolist()))
