"""Text preparation for topic analytics (F1-F8).

All per-row steps are native array expressions on the token list (no
explode and re-group, so no shuffle): the lemma dictionary and the stop list
are fixed-size tables inlined in the plan -- the stop test compiles to a hash
set lookup (``InSet``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textrisk.functions import text as T
from textrisk.functions.lemma import lemma
from textrisk.lexicons import lemma_pairs, topic_stopwords
from textrisk.operators.screen import dedup_first


def clean_text(df: DataFrame, text_col: str, out_col: str = "cleaned") -> DataFrame:
    """URL, @mention and #tag -> space; non-ASCII-letter -> space; lower;
    white space collapsed; trimmed."""
    return df.withColumn(out_col, T.clean_for_topics(F.col(text_col)))


def dedup_cleaned(df: DataFrame, cleaned_col: str, order_col: str) -> DataFrame:
    """first row per cleaned text (file order)."""
    return dedup_first(df, [cleaned_col], order_col)


def stopword_table(spark: SparkSession, words: Sequence[str] | None = None) -> DataFrame:
    """the stop list as a one-column table (for joins and inspection)."""
    ws = sorted(set(words if words is not None else topic_stopwords()))
    return spark.createDataFrame([(w,) for w in ws], "word string")


def lemma_tokens(cleaned: Column, pairs: Sequence[tuple[str, str]] | None = None,
                 stopwords: Sequence[str] | None = None) -> Column:
    """tokens -> lemma (irregular forms ``pairs``, else suffix rules) -> lower/strip ->
    keep alphabetic lemmas that are not stop words. Token order kept."""
    pairs = lemma_pairs() if pairs is None else pairs
    stop = list(topic_stopwords() if stopwords is None else stopwords)
    toks = F.filter(F.split(cleaned, " "), lambda t: t != "")
    toks = F.transform(toks, lambda t: F.lower(F.trim(lemma(t, pairs))))
    return F.filter(toks, lambda t: (t != "") & t.rlike(r"^\p{L}+$") & ~t.isin(stop))


def tokenize_filter(df: DataFrame, cleaned_col: str = "cleaned", out_col: str = "tokens",
                    pairs=None, stopwords=None) -> DataFrame:
    return df.withColumn(out_col, lemma_tokens(F.col(cleaned_col), pairs, stopwords))


def rejoin(df: DataFrame, tokens_col: str = "tokens", out_col: str = "finalized") -> DataFrame:
    """tokens joined by a space."""
    return df.withColumn(out_col, F.array_join(tokens_col, " "))


def drop_empty(df: DataFrame, out_col: str = "finalized") -> DataFrame:
    """rows whose text ended up blank are dropped."""
    return df.where(F.trim(F.col(out_col)) != "")


def rejoin_drop_empty(df: DataFrame, tokens_col: str = "tokens", out_col: str = "finalized") -> DataFrame:
    """F5 in one step. Its filter moves to the scan and takes the token expressions along, so they run
    twice; where rows are written anyway, ``drop_empty`` after the write saves that."""
    return drop_empty(rejoin(df, tokens_col, out_col), out_col)


def prepare_topic_text(df: DataFrame, text_col: str, order_col: str, pairs=None, stopwords=None) -> DataFrame:
    """F1-F5 in order: cleaned, de-duplicated, tokens, finalized text."""
    return drop_empty(finalized_texts(df, text_col, order_col, pairs, stopwords))


def finalized_texts(df: DataFrame, text_col: str, order_col: str, pairs=None, stopwords=None) -> DataFrame:
    """``prepare_topic_text`` before blank rows are dropped."""
    out = clean_text(df, text_col)
    out = dedup_cleaned(out, "cleaned", order_col)
    return rejoin(tokenize_filter(out, "cleaned", "tokens", pairs, stopwords), "tokens", "finalized")


def word_tokens(text: Column, stopwords: Sequence[str] | None = None) -> Column:
    """Analyzer tokens (>= 2 word characters, lower-cased) minus stop words."""
    stop = list(topic_stopwords() if stopwords is None else stopwords)
    return F.filter(T.analyzer_tokens(text), lambda t: ~t.isin(stop))


def bigrams(toks: Column) -> Column:
    """Adjacent pairs joined by a space (bigrams span removed stop words)."""
    nxt = F.slice(toks, 2, F.greatest(F.size(toks), F.lit(1)))
    return F.filter(F.zip_with(toks, nxt, lambda a, b: F.concat(a, F.lit(" "), b)),
                    lambda g: g.isNotNull())


def ngram_analyze(text: Column, stopwords: Sequence[str] | None = None) -> Column:
    """all unigrams, then all bigrams, of the stop-filtered tokens."""
    toks = word_tokens(text, stopwords)
    return F.concat(toks, bigrams(toks))


def term_counts(df: DataFrame, key_cols: Sequence[str], terms_col: str = "terms") -> DataFrame:
    """F8: bag of words per key: (key..., term, tf)."""
    return (df.select(*key_cols, F.explode(terms_col).alias("term"))
            .groupBy(*key_cols, "term").agg(F.count(F.lit(1)).alias("tf")))


def term_dictionary(df: DataFrame, terms_col: str = "terms", by: Sequence[str] = ()) -> DataFrame:
    """per term (and value of the ``by`` columns) the number of documents and the total count, in one aggregation by
    term: every occurrence counts once in all, the first one in a document also as a
    document (sums combine map-side; no shuffle by document)."""
    first = F.transform(F.array_distinct(terms_col), lambda t: F.struct(t.alias("term"), F.lit(1).alias("d"), F.lit(0).alias("c")))
    every = F.transform(terms_col, lambda t: F.struct(t.alias("term"), F.lit(0).alias("d"), F.lit(1).alias("c")))
    return (df.select(*by, F.explode(F.concat(first, every)).alias("_x")).select(*by, "_x.*")
            .groupBy(*by, "term").agg(F.sum("d").cast("long").alias("n_docs"), F.sum("c").cast("long").alias("n_total")))
