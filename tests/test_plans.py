"""Physical-plan properties that matter at scale (checked with explain)."""

import pytest

from textrisk.plans.registry import load_all

SF = "/root/testdata/sf0.001"
REG = load_all()


def _plan(spark, name):
    df = REG[name].build(spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_reads_only_needed_columns(spark):
    from textrisk.sources.readers import table
    plan = _plan(spark, "screen_by_lang")
    assert "n_chars" not in plan and "source" not in plan
    df = table(spark, SF, "documents", ["doc_id", "text", "lang"])
    assert df.columns == ["doc_id", "text", "lang"]
    raw = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string>" in \
        raw._jdf.queryExecution().executedPlan().toString()


def test_dedup_is_an_aggregate_not_a_window(spark):
    plan = _plan(spark, "screen_candidates")
    assert "min_by" in plan and "row_number" not in plan


def test_top_k_uses_group_limit_before_shuffle(spark):
    plan = REG["representative_docs"].build(spark, SF)._jdf.queryExecution().executedPlan().toString()
    # AQE wraps the plan; the initial plan lists the partial limit
    initial = REG["representative_docs"].build(spark, SF)._jdf.queryExecution().sparkPlan().toString()
    assert "WindowGroupLimit" in initial and "Partial" in initial
    assert plan


@pytest.mark.parametrize("name", ["model_metrics", "mcnemar_pairs", "agreement_pairs"])
def test_no_cartesian_products(spark, name):
    plan = REG[name].build(spark, SF)._jdf.queryExecution().sparkPlan().toString()
    assert "CartesianProduct" not in plan


def test_all_pairs_in_one_aggregate(spark):
    plan = REG["mcnemar_pairs"].build(spark, SF)._jdf.queryExecution().sparkPlan().toString()
    # one global aggregate feeds every pair (a single Expand-free HashAggregate pair)
    assert plan.count("HashAggregate(keys=[]") == 2
