"""Schemas of the logical tables and plan-time column checks."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

RAW_POSTS = T.StructType([
    T.StructField("date", T.StringType()),
    T.StructField("id", T.LongType()),
    T.StructField("content", T.StringType()),
    T.StructField("username", T.StringType()),
])

ANNOTATION = T.StructType([
    T.StructField("date", T.DateType()),
    T.StructField("id", T.LongType()),
    T.StructField("matched_keywords", T.StringType()),
    T.StructField("coder_A_label", T.IntegerType()),
    T.StructField("coder_B_label", T.IntegerType()),
    T.StructField("Gold_label", T.IntegerType()),
    T.StructField("gpt_4_1_label", T.IntegerType()),
    T.StructField("gpt_3_5_turbo_label", T.IntegerType()),
    T.StructField("claude_sonnet_4_6_label", T.IntegerType()),
    T.StructField("gemini_2_5_pro_label", T.IntegerType()),
])

OOF_PREDICTIONS = T.StructType([
    T.StructField("date", T.DateType()),
    T.StructField("id", T.LongType()),
    T.StructField("Gold_label", T.IntegerType()),
    T.StructField("tfidf_lr_pred", T.IntegerType()),
    T.StructField("bertweet_pred", T.IntegerType()),
    T.StructField("roberta_pred", T.IntegerType()),
    T.StructField("gpt35_pred", T.IntegerType()),
    T.StructField("gpt4_pred", T.IntegerType()),
])

AUDIT = T.StructType([
    T.StructField("date", T.TimestampType()),
    T.StructField("id", T.LongType()),
    T.StructField("risk_label", T.IntegerType()),
])

TOPIC_MAPPING = T.StructType([
    T.StructField("Topic", T.IntegerType()),
    T.StructField("Label_A", T.IntegerType()),
    T.StructField("Label_B", T.IntegerType()),
    T.StructField("Gold_label", T.IntegerType()),
    T.StructField("Topic name", T.StringType()),
    T.StructField("Count", T.IntegerType()),
    T.StructField("TopWords", T.StringType()),
])


def require_columns(df: DataFrame, cols: Iterable[str]) -> None:
    """B1: fail at plan-build time, naming every missing column."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")


def present_columns(df: DataFrame, wanted: Sequence[str]) -> tuple[list[str], list[str]]:
    """Split requested columns into (present, absent), order kept."""
    have = set(df.columns)
    return [c for c in wanted if c in have], [c for c in wanted if c not in have]
