import collections
import os

import pytest

import corpus_pipeline
from strandline.llm import mixing
from tests.llm import brute

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    names, frames = [], [docs]
    for name, stage in corpus_pipeline.STAGES:
        names.append(name)
        frames.append(stage(spark, frames[-1], SF).cache())
    assert len(names) == 5
    assert all(f.columns == docs.columns for f in frames[1:5])
    rows = [f.select("doc_id", "text", "source").collect() for f in frames[:5]]
    assert {r.doc_id for r in rows[1]} < {r.doc_id for r in rows[0]} and len(rows[1]) > 0.7 * len(rows[0])
    first = {}
    for r in sorted(rows[1], key=lambda r: r.doc_id):
        first.setdefault(brute.sha(r.text), r.doc_id)
    assert sorted(r.doc_id for r in rows[2]) == sorted(first.values())
    comp, _ = brute.components({r.doc_id: r.text for r in rows[2]})
    assert sorted(r.doc_id for r in rows[3]) == sorted({*comp.values()})
    taken = collections.Counter()
    for r in rows[4]:
        taken[r.source] += len(brute.words(r.text))
    plan = mixing.mix_plan(frames[3]).collect()
    assert all(abs(taken[r.source] - r.target) <= 1 for r in plan)
    whole = {r.doc_id: r.text for r in rows[3]}
    assert sum(r.text != whole[r.doc_id] for r in rows[4]) <= len({r.source for r in rows[4]})
    packed = frames[5].collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in rows[4]}
    assert corpus_pipeline.run(spark, SF).count() == len(packed)


def test_odd_tables(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows, clashing columns and no rows at all."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    base = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    odd = spark.createDataFrame([(None, "no id here", "en", "a", 10), (9001, None, None, None, None), (9002, "", "en", "b", 0), (9003, "long " * 60_000, "en", "b", 300_000), (9003, "long " * 60_000, "en", "b", 300_000)], base.schema)
    docs = base.union(odd).withColumns({c: spark_lit(i) for i, c in enumerate(["id", "row", "kept", "key", "size", "path", "n", "h", "component_id", "taken"])})
    frame = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, frame, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns, name
            assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
        else:
            assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
        frame = out.cache()
        assert frame.count() > 0, name


def spark_lit(value):
    from pyspark.sql import functions as F

    return F.lit(value)
