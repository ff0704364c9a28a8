"""Driver queries for the supervised baselines (E*) and fitted topic
assignment and sweeps (F11-F14, F16-F20). Model fits are checked by rows only; folds and
the training-fold TF-IDF term table are checked against SQL."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from textrisk.operators import baselines as B
from textrisk.operators import clustering as K
from textrisk.operators import density as DN
from textrisk.operators import evaluate as E
from textrisk.operators import spectral as SP
from textrisk.operators import sweeps as SW
from textrisk.operators import topics as TP
from textrisk.plans import sqlfrag as Q
from textrisk.plans.evaluation import lex_hit
from textrisk.plans.registry import query
from textrisk.plans.topics import prepared, source_key
from textrisk.session import materialize
from textrisk.sources.readers import table

K_FOLDS, SEED, MAX_FEATURES = 5, 42, 5000
FINAL_SIZE = 90


def labelled_docs(spark, sf):
    labels = table(spark, sf, "labels", ["doc_id", "toxic"]).where(F.col("toxic").isNotNull())
    docs = table(spark, sf, "documents", ["doc_id", "text"])
    return labels.join(docs, "doc_id", "inner")


_FOLD_SQL = f"""(row_number() OVER (PARTITION BY toxic ORDER BY md5(CAST(doc_id AS VARCHAR) || '-{SEED}'), doc_id) - 1)
                % {K_FOLDS}"""


@query("stratified_folds", "E1", f"""
SELECT doc_id, toxic, CAST({_FOLD_SQL} AS INTEGER) AS fold FROM labels WHERE toxic IS NOT NULL""")
def stratified_folds(spark, sf):
    labels = table(spark, sf, "labels", ["doc_id", "toxic"]).where(F.col("toxic").isNotNull())
    return B.stratified_folds(labels, "doc_id", "toxic", K_FOLDS, SEED).select("doc_id", "toxic", "fold")


@query("tfidf_train_fold", "E2", f"""
WITH ld AS (SELECT l.doc_id, l.toxic, d.text FROM labels l JOIN documents d USING (doc_id) WHERE l.toxic IS NOT NULL),
f AS (SELECT *, {_FOLD_SQL} AS fold FROM ld),
tr AS (SELECT doc_id, {Q.analyzer_tokens("coalesce(text, '')")} AS t FROM f WHERE fold <> 0),
terms AS (SELECT doc_id, list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS terms
          FROM tr),
dt AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM terms) GROUP BY 1, 2),
dic AS (SELECT term, count(*) AS n_docs, CAST(sum(tf) AS BIGINT) AS n_total FROM dt GROUP BY term),
n AS (SELECT count(*) AS n FROM tr)
SELECT term, n_docs, n_total, round(ln((1 + n) / (1 + n_docs)) + 1, 6) AS idf
FROM dic, n ORDER BY n_total DESC, term LIMIT {MAX_FEATURES}""")
def tfidf_train_fold(spark, sf):
    folds = B.stratified_folds(labelled_docs(spark, sf), "doc_id", "toxic", K_FOLDS, SEED)
    train = B.with_terms(folds.where(F.col("fold") != 0), "text")
    vocab = B.tfidf_vocabulary(train, "doc_id", "terms", MAX_FEATURES)
    return vocab.select("term", "n_docs", "n_total", F.round("idf", 6).alias("idf"))


@query("tfidf_all_folds", "E2, E4 (all folds in one pass)", f"""
WITH ld AS (SELECT l.doc_id, l.toxic, d.text FROM labels l JOIN documents d USING (doc_id) WHERE l.toxic IS NOT NULL),
f AS (SELECT *, {_FOLD_SQL} AS own FROM ld),
tk AS (SELECT doc_id, own, {Q.analyzer_tokens("coalesce(text, '')")} AS t FROM f),
terms AS (SELECT doc_id, own, list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS terms FROM tk),
dt AS (SELECT doc_id, own, term, count(*) AS tf FROM (SELECT doc_id, own, unnest(terms) AS term FROM terms) GROUP BY ALL),
k AS (SELECT unnest(range({K_FOLDS})) AS fold),
dic AS (SELECT fold, term, count(*) AS n_docs, CAST(sum(tf) AS BIGINT) AS n_total FROM dt, k WHERE own <> fold GROUP BY ALL),
n AS (SELECT fold, count(*) AS n FROM f, k WHERE own <> fold GROUP BY fold)
SELECT CAST(fold AS INTEGER) AS fold, term, n_docs, n_total, round(ln((1 + n) / (1 + n_docs)) + 1, 6) AS idf
FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY n_total DESC, term) AS r FROM dic) JOIN n USING (fold)
WHERE r <= {MAX_FEATURES}""")
def tfidf_all_folds(spark, sf):
    """The training vocabulary of every fold, from one count of all terms."""
    folds = materialize(B.with_terms(B.stratified_folds(labelled_docs(spark, sf), "doc_id", "toxic", K_FOLDS, SEED), "text"))
    return B.fold_vocabularies(folds, K_FOLDS, max_features=MAX_FEATURES).withColumn("idf", F.round("idf", 6))


@query("oof_logreg", "E3, E4, H2")
def oof_logreg(spark, sf):
    oof = B.out_of_fold(labelled_docs(spark, sf), "doc_id", "toxic", "text", K_FOLDS, SEED, ["TF-IDF + LR"],
                        MAX_FEATURES)
    return oof.select("doc_id", "fold", "gold", "pred")


@query("oof_compare", "E5, D8")
def oof_compare(spark, sf):
    ld = labelled_docs(spark, sf)
    learners = list(B.LEARNERS)
    oof = B.out_of_fold(ld, "doc_id", "toxic", "text", K_FOLDS, SEED, learners, MAX_FEATURES)
    wide = E.to_wide(oof.select("doc_id", "gold", "learner", F.col("pred").alias("label")),
                     ["doc_id", "gold"], learners, "learner")
    outside = ld.select("doc_id", lex_hit().alias("lexicon rule"))
    wide = wide.join(outside, "doc_id", "inner")
    models = [(n, F.col(f"`{n}`")) for n in learners] + [("lexicon rule", F.col("`lexicon rule`"))]
    return E.metrics_table(wide, "gold", models, constant_baseline=True)


def _vectors(spark, sf):
    emb = table(spark, sf, "embeddings", ["vec_id", "embedding"])
    return K.document_vectors(emb, "embedding")


MIN_SAMPLES, NEIGHBOURS, TEXT_DIMS = 10, 15, 32


@query("core_distances", "F13 (core distances)", f"""
WITH e AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
u AS (SELECT vec_id, i, CAST(x AS DOUBLE) / sqrt(sum(CAST(x AS DOUBLE) * x) OVER (PARTITION BY vec_id)) AS x FROM e),
d AS (SELECT a.vec_id, b.vec_id AS o, sqrt(sum((a.x - b.x) * (a.x - b.x))) AS d
      FROM u a JOIN u b ON a.i = b.i AND a.vec_id <> b.vec_id GROUP BY 1, 2)
SELECT vec_id, round(max(d), 6) AS core FROM (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, o) AS r FROM d) WHERE r <= {MIN_SAMPLES} GROUP BY vec_id""")
def core_distances(spark, sf):
    """Distance of every unit vector to its tenth nearest other one, from all pairs for every number of vectors."""
    points, members = DN.weighted_points(table(spark, sf, "embeddings", ["vec_id", "embedding"]), "vec_id", "embedding")
    cores = DN.core_distances(points, DN.nearest_of_all(points, MIN_SAMPLES), MIN_SAMPLES)
    return members.join(cores, "id").select(F.col("row").alias("vec_id"), F.round("core", 6).alias("core"))


_MODELS: dict[tuple, tuple] = {}


def fitted(spark, sf):
    """(prepared documents, points, members, tree) of the density model of all documents, once per session
    and source: hashed tf-idf vectors, PCA, neighbour embedding, spanning tree."""
    key = source_key(spark, sf, "density")
    if key not in _MODELS:
        prep = prepared(spark, sf)
        vectors = K.reduce_dims(K.text_vectors(prep.select("doc_id", "tokens"), "tokens"), "vector", TEXT_DIMS)
        vectors = vectors.select("doc_id", vector_to_array("reduced").alias("x"))
        texts, of_row = DN.weighted_points(vectors, "doc_id", "x")
        placed = SP.neighbour_embedding(DN.near_points(DN.in_blocks(texts), NEIGHBOURS))
        points, members, tree = DN.density_model(placed, "id", "x", MIN_SAMPLES, unit=False)
        rows = of_row.join(members.select(F.col("row").alias("id"), F.col("id").alias("point")), "id").select(
            "row", F.col("point").alias("id"))
        # Documents whose vectors are equal are one point: its weight counts them all.
        weights = rows.groupBy("id").agg(F.count(F.lit(1)).alias("weight"))
        points = materialize(points.drop("weight").join(weights, "id"), "points")
        _MODELS[key] = prep, points, materialize(rows, "rows"), tree
    return _MODELS[key]


def fitted_topics_of(spark, sf, sizes):
    """(prepared documents, (setting, doc_id, topic, membership)) of the fitted model."""
    prep, points, members, tree = fitted(spark, sf)
    swept = DN.density_sweep(points, members, tree, sizes).withColumnRenamed("row", "doc_id")
    return prep, materialize(swept, "swept")


@query("topic_assign", "F11, F12, F13")
def topic_assign(spark, sf):
    """Topic and membership of every prepared document (minimum size 90 as in the published model)."""
    return fitted_topics_of(spark, sf, [FINAL_SIZE])[1].drop("setting")


@query("fitted_topic_info", "F13, F15, F21, F22, F23 (fitted model)")
def fitted_topic_info(spark, sf):
    """Every topic of the fitted model with size, name, words and its representative documents: three by
    membership, and two more on request."""
    prep, found = fitted_topics_of(spark, sf, [FINAL_SIZE])
    weights = SW.setting_weights(SW.setting_term_counts(prep, found.select("setting", "doc_id", "topic")))
    info = SW.setting_topic_info(found, SW.setting_top_terms(weights, 10, include_outliers=True)).drop("setting")
    best = TP.representative_docs(found.where("topic <> -1"), "doc_id", "membership", 5)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda s: s["doc_id"])
    best = best.groupBy("topic").agg(ids.alias("_ids"), F.round(F.max("membership"), 6).alias("top_membership"))
    return info.join(best, "topic", "left").select(
        "topic", "count", "name", "representation", "top_membership",
        F.slice("_ids", 1, 3).alias("representatives"), F.slice("_ids", 4, 2).alias("more_representatives"))


@query("fitted_document_topics", "F21 (fitted model)")
def fitted_document_topics(spark, sf):
    """Every prepared document with its fitted topic, attached by key."""
    prep, found = fitted_topics_of(spark, sf, [FINAL_SIZE])
    return TP.document_topics(prep.select("doc_id", "finalized"), found.select("doc_id", "topic", "membership"), "doc_id")


@query("seed_sweep", "F20, D16")
def seed_sweep(spark, sf):
    seeds = K.draw_seeds(5, exclude=SEED)
    runs = K.sweep_seeds(_vectors(spark, sf), "vec_id", "vector", seeds, n_clusters=10, min_cluster_size=30)
    return runs.select("seed", "n_topics", "outlier_ratio", "n_non_outlier", "n_docs")


# ------------------------------------------------------------------ F19, F20 on fitted topics
SIZES = [50, 60, 70, 80, 90, 100]


def _doc_clusters(spark, sf, n_clusters, seeds):
    """Prepared documents, hashed tf-idf vectors, PCA(5), one k-means per
    seed, rows far from their centre as outliers."""
    prep = prepared(spark, sf)
    reduced = K.reduce_dims(K.text_vectors(prep.select("doc_id", "tokens"), "tokens"), "vector", 5)
    reduced = materialize(reduced.select("doc_id", "reduced"))
    return prep, {s: K.distance_outliers(reduced, "reduced", n_clusters, s) for s in seeds}


@query("topic_model_sweep", "F11-F14, F16-F19 (fitted, min size sweep)")
def topic_model_sweep(spark, sf):
    """One spanning tree, and for every minimum size its topics with outlier ratio, C_V, C_NPMI and
    diversity, all sizes in the same jobs."""
    prep, found = fitted_topics_of(spark, sf, SIZES)
    return K.sweep_metrics(prep, found.select("setting", "doc_id", "topic"), SIZES).withColumnRenamed("setting", "min_cluster_size")


@query("topic_sweep_info", "F15, F19 (fitted, per size)")
def topic_sweep_info(spark, sf):
    """topic_info of the fitted model for every minimum size."""
    prep, found = fitted_topics_of(spark, sf, SIZES)
    weights = SW.setting_weights(SW.setting_term_counts(prep, found.select("setting", "doc_id", "topic")))
    return SW.setting_topic_info(found, SW.setting_top_terms(weights, 10, include_outliers=True)).withColumnRenamed(
        "setting", "min_cluster_size")


def _seed_topics(spark, sf):
    """(prepared documents, (setting = seed, doc_id, topic), seeds) of the seed runs."""
    seeds = K.draw_seeds(5, exclude=SEED)
    prep, clusters = _doc_clusters(spark, sf, 12, seeds)
    parts = []
    for s in seeds:
        parts.append(K.assign_topics(clusters[s], "doc_id", 90).withColumn("setting", F.lit(s)))
    asg = parts[0]
    for p in parts[1:]:
        asg = asg.unionByName(p)
    return prep, asg, seeds


@query("topic_seed_sweep", "F20 (fitted, seeds), D16")
def topic_seed_sweep(spark, sf):
    """Five k-means seeds besides the primary one at a fixed minimum size,
    each with the full metric row."""
    prep, asg, seeds = _seed_topics(spark, sf)
    return K.sweep_metrics(prep, asg, seeds).withColumnRenamed("setting", "seed")


@query("topic_seed_words", "F20 (top words with counts per seed)")
def topic_seed_words(spark, sf):
    """Size and top words of every topic of the same seed runs."""
    prep, asg, seeds = _seed_topics(spark, sf)
    return K.sweep_top_words(prep, asg, seeds).withColumnRenamed("setting", "seed")
