"""Readers, sinks and plan-time checks."""

import os

import pytest
from pyspark.sql import functions as F

from textrisk.schema import present_columns, require_columns
from textrisk.sources.readers import optional_source, parse_list_column, scan_csv, scan_templates
from textrisk.sources.sinks import sink
from pyspark.sql import types as T


def test_scan_csv_multiline_and_list_column(spark, tmp_path):
    p = tmp_path / "posts.csv"
    p.write_text('date,id,content,username\n2023-01-11,1612980000000000000,"line one\nsaid ""hi""",u1\n'
                 "2023-02-15,1625810000000000001,plain,u2\n", encoding="utf-8")
    schema = T.StructType([T.StructField("date", T.StringType()), T.StructField("id", T.LongType()),
                           T.StructField("content", T.StringType()), T.StructField("username", T.StringType())])
    rows = scan_csv(spark, str(p), schema).orderBy("id").collect()
    assert rows[0].content == 'line one\nsaid "hi"' and rows[0].id == 1612980000000000000
    df = spark.createDataFrame([("['risk', 'responsibility', 'risk']",)], "m string")
    assert df.select(parse_list_column("m").alias("a")).collect()[0].a == ["risk", "responsibility", "risk"]


def test_sink_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, s string")
    out = str(tmp_path / "deep" / "folder")
    sink(df, out, "csv")
    assert spark.read.option("header", True).csv(out).count() == 2


def test_scan_templates(spark):
    here = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "textrisk", "lexicons",
                        "prompts", "*.txt")
    t = {r.name: r.template for r in scan_templates(spark, here).collect()}
    assert set(t) == {"primary_prompt", "variant_a_minimal", "variant_b_paraphrased", "variant_c_reordered"}
    assert all(v.count("{tweet}") == 1 for v in t.values())


def test_optional_source_missing(spark, tmp_path):
    assert optional_source(spark, str(tmp_path / "nope")) is None


def test_require_and_present_columns(spark):
    df = spark.createDataFrame([(1, "x")], "id long, content string")
    with pytest.raises(ValueError, match="username"):
        require_columns(df, ["id", "content", "username"])
    assert present_columns(df, ["content", "gpt", "id"]) == (["content", "id"], ["gpt"])
    assert df.select(F.lit(1)).count() == 1


def test_text_tables_are_dealt_only_on_request(spark):
    from textrisk.sources.readers import TEXT_PARTITIONS, deal, table
    one = spark.range(1000).coalesce(1).withColumnRenamed("id", "doc_id")
    out = deal(one, 6)
    assert out.inputFiles() and len(out.inputFiles()) == 6 and out.count() == 1000
    sf = "/root/testdata/sf0.001"
    assert table(spark, sf, "documents").inputFiles()[0].endswith("sf0.001/documents.parquet")
    spark.conf.set(TEXT_PARTITIONS, "3")
    try:
        dealt = table(spark, sf, "documents", ["doc_id", "text"])
        assert len(dealt.inputFiles()) == 3 and dealt.columns == ["doc_id", "text"]
        plan = dealt._jdf.queryExecution().executedPlan().toString()
        assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    finally:
        spark.conf.unset(TEXT_PARTITIONS)


def test_optional_source_lets_other_errors_through(spark, tmp_path):
    (tmp_path / "broken.parquet").write_text("not parquet")
    with pytest.raises(Exception):
        optional_source(spark, str(tmp_path / "broken.parquet")).count()
