"""Text preparation, c-TF-IDF, coherence window counts, sweeps, ranking."""

import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window

from textrisk.functions import text as T
from textrisk.functions.ranking import rank_within
from textrisk.operators import coherence as CO
from textrisk.operators import textprep as P
from textrisk.operators import topics as TP


def test_clean_text(spark):
    df = spark.createDataFrame([("See https://x.y @josé #tag Don't STOP!",)], "t string")
    assert df.select(T.clean_for_topics(F.col("t")).alias("c")).collect()[0].c == "see don t stop"


def test_analyzer_unigrams_then_bigrams(spark):
    df = spark.createDataFrame([("a bias of model",)], "t string")
    got = df.select(P.ngram_analyze(F.col("t"), ["of"]).alias("x")).collect()[0].x
    assert got == ["bias", "model", "bias model"]


def test_lemma_and_stopwords(spark):
    df = spark.createDataFrame([("the models were biased and children",)], "t string")
    got = df.select(P.lemma_tokens(F.col("t")).alias("x")).collect()[0].x
    assert got == ["model", "biased", "child"]


def test_prepare_drops_blank_and_dedups(spark):
    df = spark.createDataFrame([(1, "The and of"), (2, "Risky models!"), (3, "risky   MODELS")],
                               "id long, text string")
    out = P.prepare_topic_text(df, "text", "id").orderBy("id").collect()
    assert [(r.id, r.finalized) for r in out] == [(2, "risky model")]


def _py_ctfidf(class_docs):
    """Plain-Python c-TF-IDF (BM25 idf, sqrt tf) on {topic: [token lists]}."""
    counts = {}
    for topic, docs in class_docs.items():
        joined = [t for d in docs for t in d]
        grams = joined + [a + " " + b for a, b in zip(joined, joined[1:])]
        for g in grams:
            counts[(topic, g)] = counts.get((topic, g), 0) + 1
    tot = {}
    f = {}
    for (topic, g), c in counts.items():
        tot[topic] = tot.get(topic, 0) + c
        f[g] = f.get(g, 0) + c
    a = int(sum(tot.values()) / len(tot))
    return {(t, g): math.sqrt(c / tot[t]) * math.log(1 + (a - f[g] + 0.5) / (f[g] + 0.5))
            for (t, g), c in counts.items()}


def test_class_tfidf_matches_python(spark):
    docs = [(1, 0, "risk model bias"), (2, 0, "bias data"), (3, 1, "privacy data leak"),
            (4, -1, "random words here"), (5, 1, "leak privacy"), (6, 0, "model")]
    df = spark.createDataFrame(docs, "id long, topic int, text string")
    counts = TP.class_term_counts(df, "topic", "id", "text", stopwords=[])
    got = {(r.topic, r.term): r.weight for r in TP.class_tfidf(counts).collect()}
    cls = {}
    for _, t, text in sorted(docs):
        cls.setdefault(t, []).append(text.split())
    exp = _py_ctfidf(cls)
    assert set(got) == set(exp)
    for k, v in exp.items():
        assert got[k] == pytest.approx(v, rel=1e-12)


def test_top_terms_and_diversity(spark):
    w = spark.createDataFrame([(0, "a", 0.5), (0, "b", 0.4), (0, "c", -0.1), (1, "a", 0.3), (-1, "z", 0.9)],
                              "topic int, term string, weight double")
    top = TP.top_terms(w, 2)
    assert sorted((r.topic, r.rank, r.term) for r in top.collect()) == [(0, 1, "a"), (0, 2, "b"), (1, 1, "a")]
    d = TP.topic_diversity(top).collect()[0]
    assert d.topic_diversity == pytest.approx(2 / 3)


def test_no_topics_diversity_zero(spark):
    w = spark.createDataFrame([(-1, "z", 0.9)], "topic int, term string, weight double")
    assert TP.topic_diversity(TP.top_terms(w, 2)).collect()[0].topic_diversity == 0.0


@pytest.mark.parametrize("w", [3, 10])
def test_window_counts_equal_brute_force(spark, w):
    rnd = random.Random(w)
    vocab = list("abcdefg")
    texts = [[rnd.choice(vocab) for _ in range(rnd.randint(0, 25))] for _ in range(40)]
    texts.append(["a", "b", "c", "d", "e"])
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, terms array<string>")
    tw = spark.createDataFrame([(0, "a"), (0, "b"), (0, "c"), (1, "c"), (1, "d"), (1, "g")],
                               "topic int, term string")
    occ, co, total = CO.window_counts(df, tw, w)
    b_occ, b_co, b_n = CO.brute_force_counts(texts, w)
    assert total.collect()[0].N == b_n
    for r in occ.collect():
        assert r.occ == b_occ.get(r.word, 0)
    for r in co.collect():
        assert r.co == b_co.get((r.w1, r.w2), 0), (r.w1, r.w2)


def test_five_tokens_window_three_has_three_windows(spark):
    df = spark.createDataFrame([(0, ["a", "b", "c", "d", "e"])], "doc_id long, terms array<string>")
    tw = spark.createDataFrame([(0, "a"), (0, "e")], "topic int, term string")
    _, _, total = CO.window_counts(df, tw, 3)
    assert total.collect()[0].N == 3
    _, _, total10 = CO.window_counts(df, tw, 10)
    assert total10.collect()[0].N == 1


def _py_npmi(texts, topics, w):
    occ, co, n = CO.brute_force_counts(texts, w)
    eps = 1e-12

    def npmi(a, b):
        c = occ[a] if a == b else co.get(tuple(sorted((a, b))), 0)
        pxy = c / n
        return math.log((pxy + eps) / ((occ[a] / n) * (occ[b] / n))) / -math.log(pxy + eps)
    return npmi


def test_coherence_npmi_and_cv_match_python(spark):
    rnd = random.Random(3)
    vocab = list("abcdefgh")
    texts = [[rnd.choice(vocab) for _ in range(rnd.randint(1, 30))] for _ in range(30)]
    topics = {0: ["a", "b", "c"], 1: ["d", "e", "f", "g"]}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, terms array<string>")
    tw = spark.createDataFrame([(k, w) for k, ws in topics.items() for w in ws], "topic int, term string")
    npmi10 = _py_npmi(texts, topics, 10)
    exp_npmi = {k: sum(npmi10(a, b) for a in ws for b in ws if a != b) / (len(ws) * (len(ws) - 1))
                for k, ws in topics.items()}
    got = {r.topic: r.coherence for r in CO.coherence_npmi(df, tw, 10).collect()}
    for k in topics:
        assert got[k] == pytest.approx(exp_npmi[k], rel=1e-9)
    npmi110 = _py_npmi(texts, topics, 110)
    exp_cv = {}
    for k, ws in topics.items():
        s = {j: sum(npmi110(i, j) for i in ws) for j in ws}
        ns = math.sqrt(sum(v * v for v in s.values()))
        cos = []
        for i in ws:
            u = {j: npmi110(i, j) for j in ws}
            cos.append(sum(u[j] * s[j] for j in ws) / (math.sqrt(sum(v * v for v in u.values())) * ns))
        exp_cv[k] = sum(cos) / len(cos)
    got_cv = {r.topic: r.coherence for r in CO.coherence_cv(df, tw, 110).collect()}
    for k in topics:
        assert got_cv[k] == pytest.approx(exp_cv[k], rel=1e-9)


def test_min_size_sweep(spark):
    rows = [(i, 0) for i in range(120)] + [(1000 + i, 1) for i in range(95)] + [(2000 + i, 2) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, topic int")
    got = {r.min_size: r.n_topics for r in TP.sweep_min_size(df, [50, 90, 100]).collect()}
    assert got == {50: 3, 90: 2, 100: 1}


def test_no_topics_counts(spark):
    df = spark.createDataFrame([(1, -1), (2, -1)], "id long, topic int")
    r = TP.topic_counts(df).collect()[0]
    assert (r.n_topics, r.outlier_ratio, r.n_non_outlier) == (0, 1.0, 0)


def test_rank_within_equals_row_number(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choice([0, 0, 0, 1, 2, None]), rnd.random()) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, g int, k double")
    got = {r.id: r["rank"] for r in rank_within(df, ["g"], ["k", "id"], num_partitions=7).collect()}
    w = Window.partitionBy("g").orderBy("k", "id")
    exp = {r.id: r.rn for r in df.withColumn("rn", F.row_number().over(w)).collect()}
    assert got == exp


def test_sweep_metrics_equals_single_assignment_row(spark):
    """Shared window counts over (setting, topic) keys give the same row as
    the stand-alone computation for one assignment (checked against SQL in
    the driver tests)."""
    from textrisk.operators.clustering import sweep_metrics
    from textrisk.plans.registry import load_all
    from textrisk.plans.topics import prepared
    sf = "/root/testdata/sf0.001"
    prep = prepared(spark, sf)
    asg = prep.select(F.lit(7).alias("setting"), "doc_id", "topic")
    asg2 = prep.select(F.lit(8).alias("setting"), "doc_id", F.lit(-1).alias("topic"))
    got = {r.setting: r for r in sweep_metrics(prep, asg.unionByName(asg2), [7, 8]).collect()}
    exp = load_all()["topic_model_metrics"].build(spark, sf).collect()[0]
    g = got[7]
    assert g.n_topics == exp.n_topics
    for k in ("outlier_ratio", "c_v", "c_npmi", "topic_diversity"):
        assert round(g[k], 6) == pytest.approx(exp[k], abs=1e-6), k
    assert got[8].n_topics == 0 and got[8].outlier_ratio == 1.0 and got[8].topic_diversity == 0.0


def test_rank_within_with_a_payload_and_many_rows(spark):
    """More rows per task than the range sample holds, and a column that only the result needs."""
    df = spark.range(200_000).select("id", (F.col("id") % 3).alias("g"), F.xxhash64("id").alias("k"),
                                     F.repeat(F.lit("x"), 50).alias("payload"))
    got = rank_within(df, ["g"], ["k", "id"], num_partitions=3)
    from pyspark.sql import Window
    want = df.select("id", F.row_number().over(Window.partitionBy("g").orderBy("k", "id")).alias("r"))
    assert got.join(want, "id").where("rank = r and payload is not null").count() == 200_000


def _blobs(spark, n=400):
    rnd = random.Random(8)
    rows = [(i, [float(i % 2 == 0) + rnd.gauss(0, 0.05), float(i % 2) + rnd.gauss(0, 0.05), rnd.gauss(0, 0.05)]) for i in range(n)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    from textrisk.operators.clustering import document_vectors
    return document_vectors(df, "embedding")


def test_seed_and_size_sweeps_have_distance_outliers(spark):
    from textrisk.operators import clustering as K
    vectors = _blobs(spark)
    for r in K.sweep_seeds(vectors, "vec_id", "vector", [3, 4], n_clusters=2, min_cluster_size=10, dims=2).collect():
        assert r.n_topics == 2 and 0.02 < r.outlier_ratio < 0.08
    far = K.distance_outliers(K.reduce_dims(vectors, "vector", 2), "reduced", 2, 3)
    n_far = far.where("cluster = -1").count()
    got = K.assignments_by_min_size(far, "vec_id", [10, 15])
    assert n_far >= 15 and got.count() == 800
    assert got.where("topic = -1").count() == 2 * n_far and got.agg(F.max("topic")).first()[0] == 1


def test_top_words_with_counts_per_seed(spark):
    from textrisk.operators.clustering import sweep_top_words
    rows = [(i, "apple pear" if i % 3 else "engine wheel") for i in range(30)]
    prep = spark.createDataFrame(rows, "doc_id long, finalized string")
    asg = prep.select(F.lit(5).alias("setting"), "doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("topic")).unionByName(
        prep.select(F.lit(6).alias("setting"), "doc_id", F.when(F.col("doc_id") < 4, -1).otherwise(0).alias("topic")))
    got = {(r.setting, r.topic): (r.n_docs, r.top_words) for r in sweep_top_words(prep, asg, [5, 6], top_n=2).collect()}
    assert {k: v[0] for k, v in got.items()} == {(5, 0): 20, (5, 1): 10, (6, 0): 26}
    assert not set("engine wheel".split()) & set(got[5, 0][1].split()) and "engine" in got[5, 1][1]
