"""Topic -> category roll-up and coder checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textrisk.functions.stats import divnull, wilson_interval
from textrisk.lexicons import CATEGORY_NAMES
from textrisk.operators.evaluate import kappa_table


def category_names(spark: SparkSession) -> DataFrame:
    """The five category names as a fixed dimension table."""
    return spark.createDataFrame(sorted(CATEGORY_NAMES.items()), "category int, category_name string")


def coder_agreement(mapping: DataFrame, a_col: str = "label_a", b_col: str = "label_b") -> DataFrame:
    """G1: multi-class kappa between the two coders' categories."""
    return kappa_table(mapping, a_col, b_col)


def category_rollup(topics: DataFrame, topic_col: str = "topic", count_col: str = "n_docs",
                    category_col: str = "category") -> DataFrame:
    """G2 + G3: topics and documents per category and the share of all
    documents in the table. ``topics`` is one row per topic (already small);
    the total is a window over the aggregated rows."""
    agg = topics.groupBy(category_col).agg(F.count(topic_col).alias("n_topics"),
                                           F.sum(count_col).cast("long").alias("n_documents"))
    total = F.sum("n_documents").over(Window.partitionBy(F.lit(0)))
    out = agg.withColumn("share_pct", divnull(F.col("n_documents") * 100, total))
    names = category_names(topics.sparkSession).withColumnRenamed("category", category_col)
    return out.join(F.broadcast(names), category_col, "left")


def top_topics_per_category(topics: DataFrame, n: int = 3, topic_col: str = "topic",
                            count_col: str = "n_docs", category_col: str = "category") -> DataFrame:
    """The n largest topics per category; ties by topic id."""
    w = Window.partitionBy(category_col).orderBy(F.col(count_col).desc(), F.col(topic_col))
    return topics.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def category_violations(doc_topics: DataFrame, mapping: DataFrame, topic_col: str = "topic",
                        category_col: str = "category") -> DataFrame:
    """Non-outlier topics with no category or with more than one.
    An empty result means the mapping is sound."""
    counts = (mapping.where(F.col(topic_col) != -1).groupBy(topic_col)
              .agg(F.countDistinct(category_col).alias("n_categories")))
    multi = counts.where(F.col("n_categories") > 1).withColumn("problem", F.lit("multiple_categories"))
    present = doc_topics.where(F.col(topic_col) != -1).select(topic_col).distinct()
    unmapped = (present.join(counts.select(topic_col), topic_col, "left_anti")
                .withColumn("n_categories", F.lit(0).cast("long"))
                .withColumn("problem", F.lit("unmapped")))
    return multi.unionByName(unmapped)


def coder_disagreements(mapping: DataFrame, a_col: str = "label_a", b_col: str = "label_b") -> DataFrame:
    """Topics where the coders differ, with the reconciled label."""
    return mapping.where(F.col(a_col) != F.col(b_col))


def coverage_audit(sample: DataFrame, label_col: str) -> DataFrame:
    """G7 (D1 + D15): positives in an audit sample and their Wilson interval."""
    out = sample.agg(F.count(F.lit(1)).alias("n_sampled"),
                     F.count(label_col).alias("n"),
                     F.count_if(F.col(label_col) == 1).alias("positives"))
    lo, hi = wilson_interval("positives", "n")
    return out.select("*", divnull(F.col("positives"), F.col("n")).alias("share"),
                      lo.alias("ci_low"), hi.alias("ci_high"))
