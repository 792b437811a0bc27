"""The jobs on copies: reruns, growing input, a batch that is repeated, odd rows, the command line."""

import os
import random
import subprocess
import sys
import uuid

import duckdb
import pytest

from jobs import queries, read_screen, seed_index, settings
from strandline.operators import index
from strandline.plans import mapper
from strandline.plans.options import preset
from tests import scalar

SCHEMA = "doc_id long, text string, frequent string, key string, batch long, call string"
CONFIG = {"id": "doc_id", "text": "text", "k": 15, "w": 11}
INDEX = {**CONFIG, "frequent_fraction": 0.02, "min_cap": 2, "max_cap": 50, "buckets": 4}
SCREEN = {**CONFIG, "min_shared": 2, "min_share": 0.05, "files_per_batch": 2}
rng = random.Random(12)


def dna(n):
    return "".join(rng.choices("ACGT", k=n))


def write(spark, path, rows, mode="overwrite"):
    spark.createDataFrame([(i, t, "x", "y", 3, "z") for i, t in rows], SCHEMA).coalesce(1).write.mode(mode).parquet(path)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_job_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    want = con.execute(queries.ORACLES[name])
    cols = [c[0] for c in want.description]
    before = {t.name for t in spark.catalog.listTables()}
    assert rows(queries.QUERIES[name](spark, "/root/testdata/sf0.001").select(*cols)) == sorted(want.fetchall(), key=str)
    assert all(t.startswith("strandline_") for t in {t.name for t in spark.catalog.listTables()} - before)


def plain_index(texts, cap):
    """key -> (n, n_seqs, places) by the scalar sampler."""
    out = {}
    for i, t in texts:
        for key, pos in scalar_seeds(t):
            out.setdefault(key, []).append((i, pos))
    return {k: (len(v), len({i for i, _ in v}), v if len(v) <= cap else None) for k, v in out.items()}


def scalar_seeds(t, k=15, w=11):
    seq = "".join(c for c in (t or "").upper() if c in "ACGT")
    num = lambda s: sum("ACGT".index(c) << 2 * j for j, c in enumerate(s))
    big = lambda s: int("".join(str("ACGT".index(c)) for c in s), 4)  # noqa: E731, F841
    out = []
    for pos in sorted({p for p, _ in scalar.minimizers(seq, k, w)}):
        f, r = seq[pos : pos + k], scalar.rc(seq[pos : pos + k])
        out.append((scalar.masked_hash(min(num(f), num(r)), k), pos + k - 1))
    return out


def test_index_of_odd_rows_and_reruns(spark, tmp_path):
    shared = dna(120)
    texts = [(1, dna(300)), (2, shared + dna(60)), (3, dna(40) + shared), (4, None), (5, ""), (None, shared), (7, "no bases: !?"), (8, shared.lower()), (9, "A" * 5000), (9, dna(90)), (9, dna(90)), (10, "汉" * 9 + dna(50))]
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    write(spark, src, texts)
    done = seed_index.run(spark, src, out, INDEX)
    first = rows(seed_index.output(spark, out))
    want = plain_index(texts, done["cap"])
    got = {r["key"]: (r.n, r.n_seqs) for r in seed_index.keys(spark, out).collect()}
    assert got == {k: v[:2] for k, v in want.items()} and done["sequences"] == len(texts)
    places = {}
    for r in seed_index.seeds(spark, out).collect():
        places.setdefault(r["key"], []).append((r.seq_id, r.pos))
    assert {k: sorted(v, key=str) for k, v in places.items()} == {k: sorted(v[2], key=str) for k, v in want.items() if v[2] is not None}
    assert any(v[2] is None for v in want.values()) and done["frequent"] == sum(v[2] is None for v in want.values())
    assert seed_index.run(spark, src, out, INDEX) == done and rows(seed_index.output(spark, out)) == first
    write(spark, src, texts[:3])  # less input: nothing of the former run stays
    seed_index.run(spark, src, out, INDEX)
    assert set(seed_index.keys(spark, out).select("key").toPandas()["key"]) == set(plain_index(texts[:3], 50))
    write(spark, src, [])
    assert seed_index.run(spark, src, out, INDEX)["keys"] == 0 and seed_index.output(spark, out).count() == 0


def test_screen_of_growing_input(spark, tmp_path):
    panel = [(100, dna(400)), (101, dna(400)), (102, dna(200))]
    src, reads, out, mark = (str(tmp_path / x) for x in ("src", "reads", "out", "mark"))
    write(spark, src, panel)
    seed_index.run(spark, src, str(tmp_path / "panel"), {**INDEX, "min_cap": 10})
    call = lambda: read_screen.run(spark, reads, str(tmp_path / "panel"), out, mark, SCREEN)
    first = [(1, panel[0][1][50:250]), (2, dna(200)), (3, None), (4, ""), (None, dna(50)), (5, dna(30) + panel[1][1][:120])]
    write(spark, reads, first)
    assert call() == {"batches": 1, "reads": 6, "without_id": 1, "matches": 2}
    one = rows(read_screen.output(spark, out))
    assert {r[0]: (r[3], r[6]) for r in one} == {1: (100, "match"), 2: (None, "clean"), 3: (None, "clean"), 4: (None, "clean"), 5: (101, "match")}
    assert call() == {"batches": 0, "reads": 0, "without_id": 0, "matches": 0} and rows(read_screen.output(spark, out)) == one
    more = [(6, panel[2][1]), (6, panel[2][1]), (7, panel[0][1][:100] + panel[1][1][:100])]
    write(spark, reads, more, "append")
    assert call()["reads"] == 3
    two = rows(read_screen.output(spark, out))
    assert set(one) < set(two) and len(two) == len(one) + 2
    # the commit of the last batch is lost: it is done again, and no row comes twice
    last = max((f for f in os.listdir(f"{mark}/commits") if f.isdigit()), key=int)
    for f in (last, f".{last}.crc"):
        os.remove(f"{mark}/commits/{f}")
    assert call()["reads"] == 3 and rows(read_screen.output(spark, out)) == two
    for r in two:  # by sets of keys
        text = dict([*first, *more])[r[0]]
        keys = {k for k, _ in scalar_seeds(text)}
        shared = {i: len(keys & {k for k, _ in scalar_seeds(t)}) for i, t in panel}
        best = max(shared, key=lambda i: (shared[i], -i))
        assert (r[1], r[4]) == (len(keys), shared[best]) and r[3] == (best if shared[best] else None)


def test_command_line(tmp_path, spark):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    write(spark, src, [(1, dna(300))])
    env = {**os.environ, "SPARK_LOCAL_DIRS": str(tmp_path)}
    done = subprocess.run([sys.executable, "-m", "jobs.seed_index", src, out], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "1 sequences, 300 bases" in done.stderr and seed_index.output(spark, out).count() > 10
    assert settings(spark, f"{queries.HERE}/read_screen.json")["min_shared"] == 2


# ------------------------------------------------------------------ the index underneath

def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_look_ups_do_not_shuffle_the_index(spark, tmp_path):
    """Joins on the key have one Exchange, that of what is looked up; groups on it have none."""
    seeds = spark.createDataFrame([(i % 50, i, 15, i, 0) for i in range(2000)], "key long, seq_id long, span int, pos long, strand int")
    path = str(tmp_path / f"i-{uuid.uuid4().hex}'quoted")
    for _ in range(2):  # saved again over itself
        index.save(seeds, path)
    x = index.load(spark, path)
    assert rows(x.select(seeds.columns)) == rows(seeds)
    wanted = spark.range(0, 100, 3).select(spark.range(1).columns[0]).withColumnRenamed("id", "key")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = wanted.join(x, "key")
        assert plan(joined).count("Exchange hashpartitioning") == 1 and joined.count() == 17 * 40
        assert "Exchange" not in plan(index.key_counts(x)) and rows(index.key_counts(x)) == [(k, 40) for k in sorted(range(50), key=lambda k: str((k, 40)))]
        refs = spark.createDataFrame([(0, "g", dna(3000))], "rid long, name string, seq string")
        reads = spark.createDataFrame([(0, "r", dna(300))], "rid long, name string, seq string")
        m = mapper.build_index(refs, preset("map-ont"))
        q = plan(mapper.query_seeds(reads, m))
        scans = [i for i, line in enumerate(q.splitlines()) if "strandline_" in line and "Bucketed: true" in line]
        lines = q.splitlines()
        assert scans and all("Exchange hashpartitioning" not in lines[i - 1] and "Exchange hashpartitioning(key" not in lines[i - 2] for i in scans)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
