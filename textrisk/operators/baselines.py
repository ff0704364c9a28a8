"""Stratified out-of-fold supervised baselines on Spark ML.

Folds are data (a ``fold`` column), features are a Spark ML TF-IDF fitted on
the training folds only, learners are ML estimators; the driver only loops
over the k folds. The TF-IDF follows the classic vectoriser defaults:
lower-case, tokens of two or more word characters, unigrams and bigrams, the
``max_features`` most frequent terms of the training fold (ties by term),
idf = ln((1 + n) / (1 + df)) + 1, rows L2-normalised.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.classification import LinearSVC, LogisticRegression, NaiveBayes
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textrisk.functions import text as T
from textrisk.functions.ranking import rank_within
from textrisk.operators.textprep import bigrams, term_dictionary
from textrisk.session import materialize, parts_of


def stratified_folds(df: DataFrame, id_col: str, label_col: str, k: int = 5, seed: int = 42,
                     fold_col: str = "fold") -> DataFrame:
    """Class-balanced folds. Rows of each class are put in a repeatable
    shuffled order (md5 of id and seed, id as tie-break) and dealt round-robin
    into k folds; the numbering uses a distributed rank, so a large class is
    never held by one task."""
    key = F.md5(F.concat(F.col(id_col).cast("string"), F.lit("-"), F.lit(str(seed))))
    ranked = rank_within(df.withColumn("_fk", key), [label_col], ["_fk", id_col], "_fr")
    return ranked.withColumn(fold_col, ((F.col("_fr") - 1) % k).cast("int")).drop("_fk", "_fr")


def with_terms(df: DataFrame, text_col: str, out_col: str = "terms") -> DataFrame:
    """Unigrams then bigrams of the lower-cased text (no stop list)."""
    toks = T.analyzer_tokens(T.null_to_empty(text_col))
    return df.withColumn("_tok", toks).withColumn(out_col, F.concat("_tok", bigrams(F.col("_tok")))).drop("_tok")


def tfidf_vocabulary(train: DataFrame, id_col: str, terms_col: str = "terms",
                     max_features: int = 5000) -> DataFrame:
    """E2 fit: (term, n_docs, n_total, idf) for the kept vocabulary.

    The top-``max_features`` selection is a global top-k (per-task top-k,
    then one merge), not a sort of the whole dictionary.
    """
    dic = term_dictionary(train, terms_col)
    top = dic.orderBy(F.col("n_total").desc(), F.col("term")).limit(max_features)
    n = train.agg(F.count(F.lit(1)).alias("_n"))
    return top.crossJoin(n).select(
        "term", "n_docs", "n_total",
        (F.log((1.0 + F.col("_n")) / (1.0 + F.col("n_docs"))) + 1.0).alias("idf"))


def fold_vocabularies(df: DataFrame, k: int, terms_col: str = "terms", fold_col: str = "fold",
                      max_features: int = 5000) -> DataFrame:
    """E2 fits of all folds in one pass: (fold, term, n_docs, n_total, idf), the vocabulary of the rows outside
    each fold. Terms are counted once, in all and for every fold; what a fold trains on is the total less its
    own. Every fold keeps its ``max_features`` commonest terms: a bounded heap per task over the written
    counts, so no task sorts its part of the vocabulary."""
    wide = df.select(fold_col, terms_col).repartition(parts_of(df))
    first = F.transform(F.array_distinct(terms_col), lambda t: F.struct(t.alias("term"), F.lit(1).alias("d"), F.lit(0).alias("c")))
    every = F.transform(terms_col, lambda t: F.struct(t.alias("term"), F.lit(0).alias("d"), F.lit(1).alias("c")))
    rows = wide.select(F.col(fold_col).alias("_f"), F.explode(F.concat(first, every)).alias("_x")).select("_f", "_x.*")
    own = [F.sum(F.when(F.col("_f") == i, F.col(c)).otherwise(0)).alias(f"_{c}{i}") for i in range(k) for c in "dc"]
    total = materialize(rows.groupBy("term").agg(F.sum("d").alias("_d"), F.sum("c").alias("_c"), *own), "terms")
    best = [total.select(F.lit(i).alias("fold"), "term", (F.col("_d") - F.col(f"_d{i}")).cast("long").alias("n_docs"),
                         (F.col("_c") - F.col(f"_c{i}")).cast("long").alias("n_total")).where("n_docs > 0")
            .orderBy(F.col("n_total").desc(), "term").limit(max_features) for i in range(k)]
    kept = best[0]
    for b in best[1:]:
        kept = kept.unionByName(b)
    rows = df.groupBy(F.col(fold_col).alias("_f")).agg(F.count(F.lit(1)).alias("_n"))
    folds = df.sparkSession.range(k).select(F.col("id").cast("int").alias("fold"))
    n = folds.join(rows, F.col("fold") != F.col("_f"), "left").groupBy("fold").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_n"))
    return kept.join(F.broadcast(n), "fold").select(  # k rows
        "fold", "term", "n_docs", "n_total", (F.log((1.0 + F.col("_n")) / (1.0 + F.col("n_docs"))) + 1.0).alias("idf"))


class TfidfFeatures:
    """E2 model: vocabulary (sorted, as column order) and idf weights.

    The vocabulary is at most ``max_features`` entries -- a bounded model --
    so it is brought to the driver and inlined in the ML stages.
    """

    def __init__(self, vocab: list[str], idf: list[float], terms_col: str = "terms",
                 out_col: str = "features"):
        self.vocab, self.idf = vocab, idf
        self.cv = CountVectorizerModel.from_vocabulary(vocab, inputCol=terms_col, outputCol="_tf")
        self.scale = ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="_tf", outputCol="_tfidf")
        self.norm = Normalizer(p=2.0, inputCol="_tfidf", outputCol=out_col)

    @classmethod
    def fit(cls, train: DataFrame, id_col: str, terms_col: str = "terms", max_features: int = 5000,
            out_col: str = "features") -> TfidfFeatures:
        rows = tfidf_vocabulary(train, id_col, terms_col, max_features).orderBy("term").collect()
        return cls([r["term"] for r in rows], [float(r["idf"]) for r in rows], terms_col, out_col)

    def transform(self, df: DataFrame) -> DataFrame:
        return self.norm.transform(self.scale.transform(self.cv.transform(df))).drop("_tf", "_tfidf")


# Optimiser tolerance of the published baseline (its library default).
TOL = 1e-4


def logreg(n_train: int, C: float = 1.0, max_iter: int = 1000):
    """L2 logistic regression equal to C-regularised summed loss:
    Spark averages the loss, so regParam = 1 / (C * n_train)."""
    return LogisticRegression(maxIter=max_iter, regParam=1.0 / (C * max(n_train, 1)), elasticNetParam=0.0,
                              standardization=False, tol=TOL, featuresCol="features", labelCol="label")


LEARNERS: dict[str, Callable[[int], object]] = {
    "TF-IDF + LR": lambda n: logreg(n),
    "TF-IDF + linear SVM": lambda n: LinearSVC(maxIter=1000, regParam=1.0 / max(n, 1), standardization=False,
                                               tol=TOL, featuresCol="features", labelCol="label"),
    "TF-IDF + naive Bayes": lambda n: NaiveBayes(modelType="multinomial", smoothing=1.0,
                                                 featuresCol="features", labelCol="label"),
}


def out_of_fold(df: DataFrame, id_col: str, label_col: str, text_col: str, k: int = 5, seed: int = 42,
                learners: Sequence[str] = ("TF-IDF + LR",), max_features: int = 5000,
                parallelism: int | None = None, train_partitions: int | None = None) -> DataFrame:
    """E4 + E5: every row predicted once by each learner, by a model fitted on
    the other folds (vectoriser included). Returns (id, fold, gold, learner, pred).
    ``train_partitions`` sets the layout of the training rows (an optimiser pass is one
    job over them); unset, it is that of the labelled rows.

    The k folds are fitted concurrently from a thread pool (as ML's
    cross-validator does), each fold's predictions written to the shared
    checkpoint folder.
    """
    from concurrent.futures import ThreadPoolExecutor

    labelled = df.select(id_col, label_col, text_col).where(F.col(label_col).isNotNull())
    base = materialize(with_terms(stratified_folds(labelled, id_col, label_col, k, seed), text_col)
                       .drop(text_col).withColumn("label", F.col(label_col).cast("double")))

    # At most k * max_features rows.
    vocabularies = fold_vocabularies(base, k, "terms", "fold", max_features).orderBy("fold", "term").collect()

    def fit_fold(i: int) -> list[DataFrame]:
        train, test = base.where(F.col("fold") != i), base.where(F.col("fold") == i)
        own = [r for r in vocabularies if r["fold"] == i]
        feats = TfidfFeatures([r["term"] for r in own], [float(r["idf"]) for r in own])
        tr = feats.transform(train).select(id_col, "label", "features")
        tr = (tr.repartition(train_partitions) if train_partitions else tr).cache()
        te = feats.transform(test).select(id_col, "fold", F.col(label_col).alias("gold"), "features")
        n_train = tr.count()
        out = []
        try:
            for name in learners:
                model = LEARNERS[name](n_train).fit(tr)
                pred = model.transform(te).select(id_col, "fold", "gold", F.lit(name).alias("learner"),
                                                  F.col("prediction").cast("int").alias("pred"))
                out.append(materialize(pred))
        finally:
            tr.unpersist()
        return out

    with ThreadPoolExecutor(max_workers=parallelism or k) as pool:
        results = list(pool.map(fit_fold, range(k)))
    parts = [p for r in results for p in r]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
