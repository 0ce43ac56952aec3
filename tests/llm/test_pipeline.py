import pytest

import corpus_pipeline
from sequora.llm import registry
from sequora.llm.common import store


@pytest.fixture(scope="module")
def con(small):
    from oracle import connect

    return connect(small)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_oracle(spark, small, con, name):
    from oracle import same

    same(registry.QUERIES[name](spark, small), con, registry.ORACLES[name])


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = store(stage(spark, docs, small))
        assert docs.columns == columns
        now = docs.count()
        if name != "mixing":
            assert now <= before
        before = now
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, small)
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 4096").count() == 0
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_run_equals_stages(spark, small):
    n = corpus_pipeline.run(spark, small).count()
    assert n == corpus_pipeline.run(spark, small).count() > 0


def test_near_dedup_lets_the_driver_collect_twice(spark, make, prose, monkeypatch):
    """Seven collections in quick succession made the driver's heap grow beyond its limit."""
    from sequora.llm import common

    calls = []
    monkeypatch.setattr(common, "release", calls.append)
    docs = make([prose(60, 1), prose(60, 1) + " end", prose(60, 2), None])
    assert corpus_pipeline.drop_near(spark, docs, "").count() == 3
    assert len(calls) <= 2
