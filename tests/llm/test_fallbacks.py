"""The ways taken where a side is too large to broadcast give the same results."""

import pytest

from attestia.llm import common, components, linededup, mixing, ngramjoin, sharding, suffixdedup
from tests.llm import test_linededup, test_mixing, test_ngramjoin, test_sharding, test_suffixdedup


@pytest.fixture(autouse=True)
def nothing_is_small(monkeypatch):
    for module in (common, ngramjoin, suffixdedup):
        monkeypatch.setattr(module, "broadcastable", lambda *a, **k: False)
    for module in (mixing, sharding):
        monkeypatch.setattr(module, "BROADCAST_ROWS", -1)


def test_a_salted_side_is_never_broadcast(spark, tmp_path):
    spark.range(2000).selectExpr("id as k", "1 as v").write.parquet(f"{tmp_path}/small-files")
    left, right = spark.range(50).withColumnRenamed("id", "k"), spark.read.parquet(f"{tmp_path}/small-files")
    for found in (common.lookup(left, right, "k", left.k), common.lookup(left, right, "k", left.k, 1)):
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
        assert {r.k: r.v for r in found.collect()} == dict.fromkeys(range(50), 1)


def test_line_dedup(spark):
    test_linededup.test_against_brute_force(spark)
    test_linededup.test_repeats_nulls_and_empty_tables(spark)


def test_ngram_join(spark, monkeypatch):
    test_ngramjoin.check(spark, test_ngramjoin.varied(21, 200), 5, 8, 10)
    test_ngramjoin.test_large_clusters_are_grouped_again_by_rare_shingles(spark, monkeypatch)


def test_near_duplicates_of_the_pipeline_leave_the_driver_alone(spark, monkeypatch):
    """Without small sides no plan of the stage has a broadcast, not even one that Catalyst chose by the sizes of files."""
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    for module, name, value in ((ngramjoin, "CLUSTER_DOCS", 5), (ngramjoin, "BLOCK_DOCS", 4), (components, "SMALL", 20)):
        monkeypatch.setattr(module, name, value)
    plans = {}

    def seen(df, label):
        plans.setdefault(label, []).append(df._jdf.queryExecution().executedPlan().toString())
        return common.durable(df, label)

    for module in (ngramjoin, components, corpus_pipeline):
        monkeypatch.setattr(module, "durable", seen)
    rows = test_ngramjoin.varied(21, 200)
    left = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    plans["kept"] = [left._jdf.queryExecution().executedPlan().toString()]
    assert {"hooks", "links", "representatives", "groups", "lost", "kept"} <= plans.keys()
    assert not [label for label, found in plans.items() if any("Broadcast" in plan for plan in found)]
    assert sorted(x.doc_id for x in left.collect()) == sorted(i for i, _, first in test_ngramjoin.brute(rows, 5, 8, 10) if first in (i, None))


def test_components(spark):
    test_ngramjoin.test_components(spark)


def test_suffix_dedup(spark, monkeypatch):
    monkeypatch.setattr(suffixdedup, "HOT", 9)
    test_suffixdedup.check(spark, test_suffixdedup.varied(5, 100))
    test_suffixdedup.test_rows_that_share_an_id(spark)


def test_mix(spark):
    test_mixing.test_against_one_queue(spark)
    test_mixing.test_take_repeats_rows(spark)


def test_shards(spark):
    test_sharding.test_shards(spark)


def test_removals_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert linededup.common_blocks(docs).count() == 0 and suffixdedup.repeats(docs).count() == 0
