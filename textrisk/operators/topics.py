"""Topic analytics on a long (topic, term, count) table.

c-TF-IDF follows the class-based weighting of the topic-model paper
(Grootendorst 2022) with BM25-style idf and square-rooted term frequency:

    tf(t, c)  = sqrt(count(t, c) / total(c))
    idf(t)    = ln(1 + (A - f(t) + 0.5) / (f(t) + 0.5))
    A         = int(mean over classes of total(c)),  f(t) = sum_c count(t, c)

Classes include the outlier class -1. The documents of a class are joined
with a space before counting, so a bigram also spans the boundary between
one document and the next (in document order); those boundary bigrams are
added from the last and first token of neighbouring documents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textrisk.functions.ranking import next_in_group, rank_within
from textrisk.functions.stats import divnull
from textrisk.operators.textprep import bigrams, word_tokens
from textrisk.session import materialize, parts_of


def class_term_counts(docs: DataFrame, topic_col: str, order_col: str, text_col: str,
                      stopwords: Sequence[str] | None = None) -> DataFrame:
    """(topic, term, count, _f) of the per-class concatenated documents; ``_f`` is the term's count in
    all classes. Written in the order of the terms, so that the files hold hardly more than each text once.

    Per-document unigrams and bigrams are counted where the rows are
    (map-side combine per (topic, term)); the boundary bigrams need each
    document's neighbour inside its class, found by a distributed rank and an
    equi-join on (topic, rank + 1) -- no task ever holds a whole class.
    """
    # Written once: both branches read the tokens, and the filter would cut the text a second time in the scan.
    toks = materialize(docs.select(F.col(topic_col).alias("topic"), F.col(order_col).alias("_ord"),
                       word_tokens(F.col(text_col), stopwords).alias("_t")), "tokens")
    toks = toks.where(F.size("_t") > 0)
    inner = dealt_terms(toks, "topic", parts_of(toks))
    ends = toks.select("topic", "_ord", F.element_at("_t", 1).alias("first"), F.element_at("_t", -1).alias("last"))
    ranked = materialize(rank_within(ends, ["topic"], ["_ord"], "_r"))
    paired = next_in_group(ranked, ["topic"], "_r", ["first"])
    boundary = (paired.where(F.col("next_first").isNotNull())
                .select("topic", F.concat("last", F.lit(" "), "next_first").alias("term")))
    counts = inner.unionByName(boundary).groupBy("topic", "term").agg(F.count(F.lit(1)).alias("count"))
    return materialize(counts.withColumn("_f", F.sum("count").over(Window.partitionBy("term"))), "terms")


def dealt_terms(toks: DataFrame, key: str, parts: int) -> DataFrame:
    """(key, term): the words and bigrams of every token list ``_t``, in ``parts`` parts. The lists move as one
    string each (no token holds a space), a third of their size as arrays."""
    dealt = toks.select(key, F.array_join("_t", " ").alias("_s")).repartition(parts).select(key, F.split("_s", " ").alias("_t"))
    return dealt.select(key, F.explode(F.concat("_t", bigrams(F.col("_t")))).alias("term"))


def class_tfidf(counts: DataFrame, bm25: bool = True, reduce_frequent: bool = True) -> DataFrame:
    """weight per (topic, term).

    f(t) is the column ``_f``, if there is one, else a window over the term: its
    group holds one row per class that uses the term (at most the number of classes), so one shuffle by
    term serves both the sum and the weight. Class totals are an aggregate with
    one row per class, joined back (a window per class would put a whole
    class vocabulary in one task).
    """
    per_topic = counts.groupBy("topic").agg(F.sum("count").alias("_total"))
    avg = per_topic.agg(F.floor(F.avg("_total")).cast("long").alias("_A"))
    # One row per class: bounded by the number of topics (the clustering's k
    # plus the outlier class), never by the data -- broadcast, so no task is
    # handed a whole class by a hash join on the class key.
    # Parts by the size of the written counts: a task's sort by term does not grow with them.
    if "_f" not in counts.columns:
        counts = counts.repartition(parts_of(counts), "term")
        counts = counts.withColumn("_f", F.sum("count").over(Window.partitionBy("term")))
    j = counts.join(F.broadcast(per_topic), "topic").crossJoin(F.broadcast(avg))
    tf = divnull(F.col("count"), F.col("_total"))
    if reduce_frequent:
        tf = F.sqrt(tf)
    f, a = F.col("_f").cast("double"), F.col("_A").cast("double")
    idf = F.log(1.0 + (a - f + 0.5) / (f + 0.5)) if bm25 else F.log(a / f + 1.0)
    return j.select("topic", "term", "count", (tf * idf).alias("weight"))


def top_terms(weights: DataFrame, n: int = 10, include_outliers: bool = False) -> DataFrame:
    """best n terms per topic by weight (ties by term); only positive
    weights make a topic word. Spark keeps a running top-n per task
    (WindowGroupLimit) before the shuffle."""
    w = weights.where(F.col("weight") > 0)
    if not include_outliers:
        w = w.where(F.col("topic") != -1)
    win = Window.partitionBy("topic").orderBy(F.col("weight").desc(), F.col("term"))
    return w.withColumn("rank", F.row_number().over(win)).where(F.col("rank") <= n)


def topic_keywords(top: DataFrame, sep: str = " | ") -> DataFrame:
    """the ranked words of each topic joined into one string."""
    words = F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda s: s["term"])
    return top.groupBy("topic").agg(F.array_join(words, sep).alias("top_words"),
                                    F.count(F.lit(1)).alias("n_words"))


def topic_counts(doc_topics: DataFrame, topic_col: str = "topic") -> DataFrame:
    """number of topics (without -1), outlier share, non-outlier rows."""
    t = F.col(topic_col)
    return doc_topics.agg(
        F.count_distinct(F.when(t != -1, t)).alias("n_topics"),
        F.avg((t == -1).cast("double")).alias("outlier_ratio"),
        F.count_if(t != -1).alias("n_non_outlier"),
        F.count(F.lit(1)).alias("n_docs"))


def topic_info(doc_topics: DataFrame, top_all: DataFrame, topic_col: str = "topic") -> DataFrame:
    """topic, size, name (id + first four words), words -- incl. -1."""
    sizes = doc_topics.groupBy(F.col(topic_col).alias("topic")).agg(F.count(F.lit(1)).alias("count"))
    kw = topic_keywords(top_all, "|")
    words = F.split(F.col("top_words"), r"\|")
    name = F.concat_ws("_", F.col("topic").cast("string"),
                       F.array_join(F.slice(F.coalesce(words, F.array().cast("array<string>")), 1, 4), "_"))
    return (sizes.join(kw, "topic", "left")
            .select("topic", "count", name.alias("name"),
                    F.regexp_replace(F.coalesce(F.col("top_words"), F.lit("")), r"\|", " | ").alias("representation")))


def topic_diversity(top: DataFrame) -> DataFrame:
    """distinct top words / all top words (0 when there are none)."""
    return top.agg(F.coalesce(divnull(F.count_distinct("term"), F.count("term")), F.lit(0.0))
                   .alias("topic_diversity"),
                   F.count_distinct("topic").alias("n_topics"))


def apply_min_size(doc_topics: DataFrame, sizes: Sequence[int], topic_col: str = "topic") -> DataFrame:
    """F19 core: for every minimum size, clusters below it become outliers
    and the rest are renumbered by size (largest = 0, ties by old id).

    The cluster sizes are aggregated first (one row per cluster) and crossed
    with the small settings table -- rows are never multiplied by settings.
    """
    spark = doc_topics.sparkSession
    sz = (doc_topics.where(F.col(topic_col) != -1).groupBy(F.col(topic_col).alias("cluster"))
          .agg(F.count(F.lit(1)).alias("size")))
    settings = spark.createDataFrame([(int(s),) for s in sizes], "min_size int")
    kept = sz.crossJoin(F.broadcast(settings)).where(F.col("size") >= F.col("min_size"))
    w = Window.partitionBy("min_size").orderBy(F.col("size").desc(), F.col("cluster"))
    return kept.withColumn("topic", (F.row_number().over(w) - 1).cast("int"))


def sweep_min_size(doc_topics: DataFrame, sizes: Sequence[int], topic_col: str = "topic") -> DataFrame:
    """per min size: topics, outlier ratio and non-outlier rows, from
    the cluster-size table only."""
    spark = doc_topics.sparkSession
    n = doc_topics.agg(F.count(F.lit(1)).alias("n_docs"))
    kept = apply_min_size(doc_topics, sizes, topic_col)
    per = kept.groupBy("min_size").agg(F.count(F.lit(1)).alias("n_topics"),
                                       F.sum("size").cast("long").alias("n_non_outlier"))
    settings = spark.createDataFrame([(int(s),) for s in sizes], "min_size int")
    out = settings.join(per, "min_size", "left").crossJoin(n)
    nn = F.coalesce(F.col("n_non_outlier"), F.lit(0))
    return out.select("min_size", F.coalesce(F.col("n_topics"), F.lit(0)).cast("long").alias("n_topics"),
                      divnull(F.col("n_docs") - nn, F.col("n_docs")).alias("outlier_ratio"),
                      nn.alias("n_non_outlier"))


def document_topics(docs: DataFrame, assignment: DataFrame, id_col: str) -> DataFrame:
    """attach the topic to each prepared row by key (not by position)."""
    return docs.join(assignment, id_col, "left")


def representative_docs(scored: DataFrame, id_col: str, score_col: str = "score",
                        n: int = 3, topic_col: str = "topic") -> DataFrame:
    """the n best-scored documents per topic (ties by id)."""
    w = Window.partitionBy(topic_col).orderBy(F.col(score_col).desc(), F.col(id_col))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
