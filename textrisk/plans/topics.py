"""Driver queries for text preparation and topic analytics.

Topic assignments that SQL can reproduce:
* documents: topic = source number, `src0` = outliers (-1) -- gives texts
  for c-TF-IDF, top words, coherence and diversity;
* embeddings: topic = label, label 0 = outliers (-1) -- for counts, the
  minimum-size sweep and representative documents.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from textrisk.functions.lemma import lemma_sql
from textrisk.lexicons import lemma_pairs, topic_stopwords
from textrisk.operators import coherence as CO
from textrisk.operators import sweeps as SW
from textrisk.operators import textprep as P
from textrisk.operators import topics as TP
from textrisk.plans import sqlfrag as Q
from textrisk.plans.registry import query
from textrisk.session import materialize, parts_of
from textrisk.sources.readers import source_stamp, table

SIZES = [50, 60, 70, 80, 90, 100]
TOP_N = 10


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def source_topic(c="source"):
    return F.when(F.col(c) == "src0", F.lit(-1)).otherwise(F.substring(F.col(c), 4, 8).try_cast("int"))


_WRITTEN: dict[tuple, object] = {}


def source_key(spark, sf, what):
    path = f"{sf.rstrip('/')}/documents.parquet"
    return (spark.sparkContext.applicationId, path, source_stamp(spark, path), what)


def prepared(spark, sf):
    """Prepared rows (de-duplicated, tokens, finalized), written once
    per session and source to the shared checkpoint folder, as tokens alone (a few bits each,
    by dictionary; joined by a space they are the finalized text); every later
    topic query of the session reads those files instead of preparing the
    text again (keyed by application, folder and the folder's stamp). The raw rows are
    dealt evenly first: cleaning costs far more than moving them, and one row group
    is one task however many cores wait. Blank rows go after the write, else the filter
    would run the whole preparation a second time in the scan."""
    key = source_key(spark, sf, "prepared")
    if key not in _WRITTEN:
        docs = table(spark, sf, "documents", ["doc_id", "text", "source"])
        docs = docs.repartition(parts_of(docs)).select("doc_id", "text", source_topic().alias("topic"))
        texts = P.finalized_texts(docs, "text", "doc_id").select("doc_id", "topic", "tokens")
        _WRITTEN[key] = P.rejoin(materialize(texts).where(F.size("tokens") > 0))  # no token is blank
    return _WRITTEN[key]


def analyzed(spark, sf):
    return prepared(spark, sf).select("doc_id", "topic", P.ngram_analyze(F.col("finalized")).alias("terms"))


def class_weights(spark, sf, prep=None):
    """c-TF-IDF weights; the class-term counts are written once per session
    and source (they already pass through the shared folder)."""
    key = source_key(spark, sf, "class_counts")
    if key not in _WRITTEN:
        prep = prepared(spark, sf) if prep is None else prep
        _WRITTEN[key] = TP.class_term_counts(prep, "topic", "doc_id", "finalized")
    return TP.class_tfidf(_WRITTEN[key])


def topic_words(spark, sf, prep=None):
    """Top words of every non-outlier topic, written once per session and
    source (small, reused by coherence and diversity)."""
    key = source_key(spark, sf, "topic_words")
    if key not in _WRITTEN:
        _WRITTEN[key] = materialize(TP.top_terms(class_weights(spark, sf, prep), TOP_N).select("topic", "term"))
    return _WRITTEN[key]


def word_positions(spark, sf, texts, tw):
    """Positions of the topic words, written once per session and source; they serve the windows
    of every coherence query."""
    key = source_key(spark, sf, "positions")
    if key not in _WRITTEN:
        _WRITTEN[key] = CO.WordPositions(texts, tw)
    return _WRITTEN[key]


# ------------------------------------------------------------------ SQL chain
def _stop_sql():
    return Q.str_list(topic_stopwords())


_TOPIC_SQL_EXPR = "CASE WHEN source = 'src0' THEN -1 ELSE TRY_CAST(substr(source, 4) AS INTEGER) END"


def _prep_sql():
    stop = _stop_sql()
    lem = lemma_sql("t", lemma_pairs())
    return f"""
p0 AS (SELECT doc_id, {_TOPIC_SQL_EXPR} AS topic, {Q.clean_for_topics('text')} AS cleaned FROM documents),
p1 AS (SELECT * FROM p0 QUALIFY row_number() OVER (PARTITION BY cleaned ORDER BY doc_id) = 1),
p2 AS (SELECT doc_id, topic, cleaned,
              list_filter(list_transform(list_filter(string_split(cleaned, ' '), lambda t: t <> ''),
                                         lambda t: lower(trim({lem}))),
                          lambda t: t <> '' AND regexp_full_match(t, '\\p{{L}}+') AND NOT list_contains({stop}, t)) AS tokens
       FROM p1),
prep AS (SELECT doc_id, topic, cleaned, tokens, array_to_string(tokens, ' ') AS finalized FROM p2
         WHERE trim(array_to_string(tokens, ' ')) <> ''),
an AS (SELECT doc_id, topic, list_filter({Q.analyzer_tokens('finalized')}, lambda t: NOT list_contains({stop}, t)) AS t
       FROM prep),
terms AS (SELECT doc_id, topic, t,
                 list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS terms
          FROM an)"""


def _ctfidf_sql():
    return _prep_sql() + """,
tk AS (SELECT * FROM terms WHERE len(t) > 0),
inn AS (SELECT topic, term, count(*) AS c FROM (SELECT topic, unnest(terms) AS term FROM tk) GROUP BY 1, 2),
ends AS (SELECT topic, doc_id, t[1] AS first, t[len(t)] AS last FROM tk),
bnd AS (SELECT topic, last || ' ' || lead(first) OVER (PARTITION BY topic ORDER BY doc_id) AS term FROM ends),
bc AS (SELECT topic, term, count(*) AS c FROM bnd WHERE term IS NOT NULL GROUP BY 1, 2),
counts AS (SELECT topic, term, CAST(sum(c) AS BIGINT) AS count
           FROM (SELECT * FROM inn UNION ALL SELECT * FROM bc) GROUP BY 1, 2),
pt AS (SELECT topic, sum(count) AS total FROM counts GROUP BY topic),
pf AS (SELECT term, sum(count) AS f FROM counts GROUP BY term),
aa AS (SELECT CAST(floor(avg(total)) AS BIGINT) AS a FROM pt),
w AS (SELECT c.topic, c.term, c.count,
             sqrt(c.count / pt.total) * ln(1 + (aa.a - pf.f + 0.5) / (pf.f + 0.5)) AS weight
      FROM counts c JOIN pt USING (topic) JOIN pf USING (term), aa),
top_all AS (SELECT * FROM (SELECT topic, term, weight,
                  row_number() OVER (PARTITION BY topic ORDER BY weight DESC, term) AS rank
                  FROM w WHERE weight > 0) WHERE rank <= 10),
top AS (SELECT * FROM top_all WHERE topic <> -1)"""


# ------------------------------------------------------------------ F1, F2
@query("clean_text", "F1, F2", f"""
WITH {_prep_sql().strip()}
SELECT doc_id, cleaned FROM p1""")
def clean_text(spark, sf):
    docs = table(spark, sf, "documents", ["doc_id", "text"])
    out = P.dedup_cleaned(P.clean_text(docs, "text"), "cleaned", "doc_id")
    return out.select("doc_id", "cleaned")


# ------------------------------------------------------------------ F3-F5
@query("token_filter", "F3, F4, F5", f"""
WITH {_prep_sql().strip()}
SELECT doc_id, finalized, CAST(len(tokens) AS BIGINT) AS n_tokens FROM prep""")
def token_filter(spark, sf):
    return prepared(spark, sf).select("doc_id", "finalized", F.size("tokens").cast("long").alias("n_tokens"))


# ------------------------------------------------------------------ F6-F8
@query("ngram_dictionary", "F6, F7, F8", f"""
WITH {_prep_sql().strip()},
dt AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM terms) GROUP BY 1, 2)
SELECT term, count(*) AS n_docs, CAST(sum(tf) AS BIGINT) AS n_total FROM dt GROUP BY term""")
def ngram_dictionary(spark, sf):
    return P.term_dictionary(analyzed(spark, sf), "terms")


# ------------------------------------------------------------------ F9
@query("class_tfidf", "F9", f"""
WITH {_ctfidf_sql().strip()}
SELECT topic, term, count, round(weight, 6) AS weight FROM w""")
def class_tfidf(spark, sf):
    return class_weights(spark, sf).select("topic", "term", "count", r6("weight").alias("weight"))


# ------------------------------------------------------------------ F10
@query("top_terms", "F10", f"""
WITH {_ctfidf_sql().strip()}
SELECT topic, CAST(rank AS BIGINT) AS rank, term, round(weight, 6) AS weight FROM top""")
def top_terms(spark, sf):
    top = TP.top_terms(class_weights(spark, sf), TOP_N)
    return top.select("topic", F.col("rank").cast("long").alias("rank"), "term", r6("weight").alias("weight"))


# ------------------------------------------------------------------ F22
@query("topic_keywords", "F22", f"""
WITH {_ctfidf_sql().strip()}
SELECT topic, string_agg(term, ' | ' ORDER BY rank) AS top_words, count(*) AS n_words FROM top GROUP BY topic""")
def topic_keywords(spark, sf):
    return TP.topic_keywords(TP.top_terms(class_weights(spark, sf), TOP_N))


# ------------------------------------------------------------------ F15
@query("topic_info", "F15", f"""
WITH {_ctfidf_sql().strip()},
sizes AS (SELECT topic, count(*) AS count FROM prep GROUP BY topic),
kw AS (SELECT topic, list(term ORDER BY rank) AS words FROM top_all GROUP BY topic)
SELECT s.topic, s.count,
       CAST(s.topic AS VARCHAR) || '_' || array_to_string(coalesce(kw.words[1:4], []), '_') AS name,
       array_to_string(coalesce(kw.words, []), ' | ') AS representation
FROM sizes s LEFT JOIN kw USING (topic)""")
def topic_info(spark, sf):
    prep = prepared(spark, sf)
    top_all = TP.top_terms(class_weights(spark, sf, prep), TOP_N, include_outliers=True)
    return TP.topic_info(prep, top_all)


# ------------------------------------------------------------------ F18
@query("topic_diversity", "F18", f"""
WITH {_ctfidf_sql().strip()}
SELECT round(coalesce(count(DISTINCT term) / nullif(count(term), 0), 0), 6) AS topic_diversity,
       count(DISTINCT topic) AS n_topics FROM top""")
def topic_diversity(spark, sf):
    out = TP.topic_diversity(TP.top_terms(class_weights(spark, sf), TOP_N))
    return out.select(r6("topic_diversity").alias("topic_diversity"), "n_topics")


# ------------------------------------------------------------------ F16, F17
def _coherence_sql(w: int, include_self: bool):
    ordered_cond = "" if include_self else "WHERE x.term <> y.term"
    head = "WITH " + _ctfidf_sql().strip() + f""",
tw AS (SELECT topic, term FROM top),
lens AS (SELECT doc_id, len(terms) AS L FROM terms),
total AS (SELECT sum(CASE WHEN L >= {w} THEN L - {w} + 1 WHEN L > 0 THEN 1 ELSE 0 END) AS N FROM lens),
pos0 AS (SELECT doc_id, len(terms) AS L, unnest(terms) AS word, generate_subscripts(terms, 1) - 1 AS pos FROM terms),
iv AS (SELECT doc_id, word, pos, greatest(pos - {w - 1}, 0) AS a,
              least(pos, CASE WHEN L >= {w} THEN L - {w} + 1 WHEN L > 0 THEN 1 ELSE 0 END - 1) AS b
       FROM pos0 WHERE word IN (SELECT term FROM tw)),
oc AS (SELECT word, greatest(b - CASE WHEN pb IS NULL THEN a ELSE greatest(a, pb + 1) END + 1, 0) AS cov
       FROM (SELECT *, lag(b) OVER (PARTITION BY doc_id, word ORDER BY pos) AS pb FROM iv)),
occ AS (SELECT word, sum(cov) AS occ FROM oc GROUP BY word),
pairs AS (SELECT DISTINCT x.term AS w1, y.term AS w2 FROM tw x JOIN tw y ON x.topic = y.topic AND x.term < y.term),
member AS (SELECT w1, w2, w1 AS word FROM pairs UNION ALL SELECT w1, w2, w2 FROM pairs),
mp AS (SELECT m.w1, m.w2, i.doc_id, i.pos, i.a, i.b FROM iv i JOIN member m USING (word)),
uc AS (SELECT w1, w2, greatest(b - CASE WHEN pb IS NULL THEN a ELSE greatest(a, pb + 1) END + 1, 0) AS cov
       FROM (SELECT *, lag(b) OVER (PARTITION BY doc_id, w1, w2 ORDER BY pos) AS pb FROM mp)),
un AS (SELECT w1, w2, sum(cov) AS u FROM uc GROUP BY 1, 2),
co AS (SELECT p.w1, p.w2, coalesce(o1.occ, 0) + coalesce(o2.occ, 0) - coalesce(un.u, 0) AS co
       FROM pairs p LEFT JOIN un USING (w1, w2)
       LEFT JOIN occ o1 ON o1.word = p.w1 LEFT JOIN occ o2 ON o2.word = p.w2),
sym AS (SELECT w1 AS wi, w2 AS wj, co FROM co UNION ALL SELECT w2, w1, co FROM co),
ord AS (SELECT x.topic, x.term AS wi, y.term AS wj FROM tw x JOIN tw y ON x.topic = y.topic {ordered_cond}),
m AS (SELECT o.topic, o.wi, o.wj,
             CASE WHEN oi.occ > 0 AND oj.occ > 0 AND N > 0 THEN
               ln(((CASE WHEN o.wi = o.wj THEN oi.occ ELSE coalesce(s.co, 0) END) / N + 1e-12) / ((oi.occ / N) * (oj.occ / N)))
               / (-ln((CASE WHEN o.wi = o.wj THEN oi.occ ELSE coalesce(s.co, 0) END) / N + 1e-12)) END AS npmi
      FROM ord o LEFT JOIN sym s USING (wi, wj)
      LEFT JOIN occ oi ON oi.word = o.wi LEFT JOIN occ oj ON oj.word = o.wj, total)"""
    return head


@query("coherence_npmi", "F16", _coherence_sql(10, False) + """,
per AS (SELECT topic, avg(npmi) AS coherence FROM m GROUP BY topic)
SELECT topic, round(coherence, 6) AS coherence, round(avg(coherence) OVER (), 6) AS model_coherence FROM per""")
def coherence_npmi(spark, sf):
    prep = prepared(spark, sf)
    texts = prep.select("doc_id", P.ngram_analyze(F.col("finalized")).alias("terms"))
    tw = topic_words(spark, sf, prep)
    out = CO.coherence_npmi(texts, tw, 10, positions=word_positions(spark, sf, texts, tw))
    return out.select("topic", r6("coherence").alias("coherence"), r6("model_coherence").alias("model_coherence"))


@query("coherence_cv", "F17", _coherence_sql(110, True) + """,
s AS (SELECT topic, wj, sum(npmi) AS s FROM m GROUP BY topic, wj),
ns AS (SELECT topic, sqrt(sum(s * s)) AS ns FROM s GROUP BY topic),
pw AS (SELECT m.topic, m.wi, sum(m.npmi * s.s) AS dot, sqrt(sum(m.npmi * m.npmi)) AS nu
       FROM m JOIN s USING (topic, wj) GROUP BY m.topic, m.wi),
cs AS (SELECT pw.topic, dot / (nu * ns) AS cos FROM pw JOIN ns USING (topic)),
per AS (SELECT topic, avg(cos) AS coherence FROM cs GROUP BY topic)
SELECT topic, round(coherence, 6) AS coherence, round(avg(coherence) OVER (), 6) AS model_coherence FROM per""")
def coherence_cv(spark, sf):
    prep = prepared(spark, sf)
    texts = prep.select("doc_id", P.ngram_analyze(F.col("finalized")).alias("terms"))
    tw = topic_words(spark, sf, prep)
    out = CO.coherence_cv(texts, tw, 110, positions=word_positions(spark, sf, texts, tw))
    return out.select("topic", r6("coherence").alias("coherence"), r6("model_coherence").alias("model_coherence"))


# ------------------------------------------------------------------ F14, F19 (embeddings labels)
def label_topics(spark, sf):
    emb = table(spark, sf, "embeddings", ["vec_id", "label"])
    return emb.select("vec_id", F.when(F.col("label") == 0, -1).otherwise(F.col("label")).alias("topic"))


_LT_SQL = "lt AS (SELECT vec_id, CASE WHEN label = 0 THEN -1 ELSE label END AS topic FROM embeddings)"


@query("topic_counts", "F14", f"""
WITH {_LT_SQL}
SELECT count(DISTINCT CASE WHEN topic <> -1 THEN topic END) AS n_topics,
       round(avg(CASE WHEN topic = -1 THEN 1.0 ELSE 0.0 END), 6) AS outlier_ratio,
       count(*) FILTER (WHERE topic <> -1) AS n_non_outlier, count(*) AS n_docs FROM lt""")
def topic_counts(spark, sf):
    out = TP.topic_counts(label_topics(spark, sf))
    return out.select("n_topics", r6("outlier_ratio").alias("outlier_ratio"), "n_non_outlier", "n_docs")


@query("min_size_sweep", "F19", f"""
WITH {_LT_SQL},
sz AS (SELECT topic AS cluster, count(*) AS size FROM lt WHERE topic <> -1 GROUP BY topic),
st(min_size) AS (VALUES {', '.join(f'({s})' for s in SIZES)}),
kept AS (SELECT st.min_size, sz.size FROM sz CROSS JOIN st WHERE sz.size >= st.min_size),
per AS (SELECT min_size, count(*) AS n_topics, CAST(sum(size) AS BIGINT) AS nn FROM kept GROUP BY min_size),
n AS (SELECT count(*) AS n_docs FROM lt)
SELECT st.min_size, coalesce(per.n_topics, 0) AS n_topics,
       round((n.n_docs - coalesce(per.nn, 0)) / n.n_docs, 6) AS outlier_ratio,
       coalesce(per.nn, 0) AS n_non_outlier
FROM st LEFT JOIN per USING (min_size), n""")
def min_size_sweep(spark, sf):
    out = TP.sweep_min_size(label_topics(spark, sf), SIZES)
    return out.select("min_size", "n_topics", r6("outlier_ratio").alias("outlier_ratio"), "n_non_outlier")


@query("min_size_topics", "F19 (renumbering)", f"""
WITH {_LT_SQL},
sz AS (SELECT topic AS cluster, count(*) AS size FROM lt WHERE topic <> -1 GROUP BY topic),
st(min_size) AS (VALUES {', '.join(f'({s})' for s in SIZES)})
SELECT min_size, cluster, size,
       CAST(row_number() OVER (PARTITION BY min_size ORDER BY size DESC, cluster) - 1 AS INTEGER) AS topic
FROM sz CROSS JOIN st WHERE size >= min_size""")
def min_size_topics(spark, sf):
    return TP.apply_min_size(label_topics(spark, sf), SIZES).select("min_size", "cluster", "size", "topic")


# ------------------------------------------------------------------ F21
INFO_SIZES = [20, 40, 60, 100]


def _sweep_words_sql():
    return f"""
WITH {_prep_sql().strip()},
st AS (SELECT unnest({INFO_SIZES}) AS setting),
sz AS (SELECT topic, count(*) AS n FROM prep WHERE topic <> -1 GROUP BY topic),
ren AS (SELECT setting, topic AS old, row_number() OVER (PARTITION BY setting ORDER BY n DESC, topic) - 1 AS topic
        FROM sz, st WHERE n >= setting),
asg AS (SELECT st.setting, doc_id, CAST(coalesce(ren.topic, -1) AS INTEGER) AS topic
        FROM prep CROSS JOIN st LEFT JOIN ren ON ren.setting = st.setting AND ren.old = prep.topic),
tk AS (SELECT a.setting, a.topic, doc_id, t, terms FROM terms JOIN asg a USING (doc_id) WHERE len(t) > 0),
inn AS (SELECT setting, topic, term, count(*) AS c FROM (SELECT setting, topic, unnest(terms) AS term FROM tk) GROUP BY ALL),
bnd AS (SELECT setting, topic, t[len(t)] || ' ' || lead(t[1]) OVER (PARTITION BY setting, topic ORDER BY doc_id) AS term FROM tk),
counts AS (SELECT setting, topic, term, CAST(sum(c) AS BIGINT) AS count FROM (
             SELECT * FROM inn UNION ALL SELECT setting, topic, term, 1 FROM bnd WHERE term IS NOT NULL) GROUP BY ALL),
pt AS (SELECT setting, topic, sum(count) AS total FROM counts GROUP BY ALL),
pf AS (SELECT setting, term, sum(count) AS f FROM counts GROUP BY ALL),
aa AS (SELECT setting, CAST(floor(avg(total)) AS BIGINT) AS a FROM pt GROUP BY setting),
w AS (SELECT c.setting, c.topic, c.term,
             round(sqrt(c.count / pt.total) * ln(1 + (aa.a - pf.f + 0.5) / (pf.f + 0.5)), 12) AS weight
      FROM counts c JOIN pt USING (setting, topic) JOIN pf USING (setting, term) JOIN aa USING (setting)),
kw AS (SELECT setting, topic, list(term ORDER BY rank) AS words FROM (
         SELECT *, row_number() OVER (PARTITION BY setting, topic ORDER BY weight DESC, term) AS rank FROM w WHERE weight > 0)
       WHERE rank <= {TOP_N} GROUP BY ALL),
n AS (SELECT setting, topic, count(*) AS count FROM asg GROUP BY ALL)
SELECT n.setting AS min_size, n.topic, n.count,
       CAST(n.topic AS VARCHAR) || '_' || array_to_string(coalesce(kw.words[1:4], []), '_') AS name,
       array_to_string(coalesce(kw.words, []), ' | ') AS representation
FROM n LEFT JOIN kw USING (setting, topic)"""


@query("min_size_topic_info", "F19, F15 (topic words of every size in one pass)", _sweep_words_sql())
def min_size_topic_info(spark, sf):
    """The topics of the documents for every minimum size, with their words, from one count of all terms."""
    prep = prepared(spark, sf)
    renamed = TP.apply_min_size(prep, INFO_SIZES).select("cluster", F.col("min_size").alias("setting"), F.col("topic").alias("_t"))
    settings = F.explode(F.array(*[F.lit(s) for s in INFO_SIZES])).alias("setting")
    asg = (prep.select("doc_id", F.col("topic").alias("cluster"), settings).join(renamed, ["setting", "cluster"], "left")
           .select("setting", "doc_id", F.coalesce("_t", F.lit(-1)).cast("int").alias("topic")))
    weights = SW.setting_weights(SW.setting_term_counts(prep, asg)).withColumn("weight", F.round("weight", 12))
    return SW.setting_topic_info(asg, SW.setting_top_terms(weights, TOP_N, include_outliers=True)).withColumnRenamed(
        "setting", "min_size")


@query("document_topics", "F21, H2", f"""
WITH {_prep_sql().strip()},
asg AS (SELECT doc_id, {_TOPIC_SQL_EXPR} AS assigned FROM documents)
SELECT p.doc_id, a.assigned AS topic, CAST(len(p.tokens) AS BIGINT) AS n_tokens
FROM prep p LEFT JOIN asg a USING (doc_id)""")
def document_topics(spark, sf):
    prep = prepared(spark, sf).select("doc_id", F.size("tokens").cast("long").alias("n_tokens"))
    asg = table(spark, sf, "documents", ["doc_id", "source"]).select("doc_id", source_topic().alias("topic"))
    return TP.document_topics(prep, asg, "doc_id").select("doc_id", "topic", "n_tokens")


# ------------------------------------------------------------------ F23
def label_scores(spark, sf):
    """score = -euclidean distance of each vector to its label's mean vector.
    The means are aggregated by label and position, whatever the width (partial sums
    per task: labels x width rows); the mean vectors join back by label."""
    emb = table(spark, sf, "embeddings", ["vec_id", "embedding", "label"])
    means = (emb.select("label", F.posexplode("embedding").alias("i", "x"))
             .groupBy("label", "i").agg(F.avg("x").alias("mu"))
             .groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "mu"))).alias("m"))
             .select("label", F.col("m.mu").alias("mean")))
    j = emb.join(means, "label")
    sq = F.aggregate(F.zip_with(F.col("embedding").cast("array<double>"), "mean",
                                lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, x: acc + x)
    return j.select("vec_id", F.when(F.col("label") == 0, -1).otherwise(F.col("label")).alias("topic"),
                    (-F.sqrt(sq)).alias("score"))


@query("representative_docs", "F23", """
WITH e AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT label, i, avg(x) AS mu FROM e GROUP BY label, i),
d AS (SELECT e.vec_id, e.label, -sqrt(sum((CAST(e.x AS DOUBLE) - m.mu) * (CAST(e.x AS DOUBLE) - m.mu))) AS score
      FROM e JOIN m USING (label, i) GROUP BY e.vec_id, e.label),
r AS (SELECT CASE WHEN label = 0 THEN -1 ELSE label END AS topic, vec_id, score,
             row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM d)
SELECT topic, CAST(rank AS BIGINT) AS rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= 3""")
def representative_docs(spark, sf):
    out = TP.representative_docs(label_scores(spark, sf), "vec_id", "score", 3)
    return out.select("topic", F.col("rank").cast("long").alias("rank"), "vec_id", r6("score").alias("score"))


# ------------------------------------------------------------------ F14 + F16-F18 (one sweep row)
def model_row(spark, sf):
    """The sensitivity row of one topic assignment: topics, outlier ratio,
    C_V, C_NPMI and diversity -- parts computed once and joined (1 row each)."""
    prep = prepared(spark, sf)
    texts = prep.select("doc_id", P.ngram_analyze(F.col("finalized")).alias("terms"))
    tw = topic_words(spark, sf, prep)
    cnt = TP.topic_counts(prep)
    held = word_positions(spark, sf, texts, tw)
    npmi = CO.coherence_npmi(texts, tw, 10, positions=held).agg(F.first("model_coherence").alias("c_npmi"))
    cv = CO.coherence_cv(texts, tw, 110, positions=held).agg(F.first("model_coherence").alias("c_v"))
    div = TP.topic_diversity(tw.withColumn("rank", F.lit(1)))
    return (cnt.crossJoin(npmi).crossJoin(cv).crossJoin(div.select("topic_diversity"))
            .select("n_topics", r6("outlier_ratio").alias("outlier_ratio"), r6("c_v").alias("c_v"),
                    r6("c_npmi").alias("c_npmi"), r6("topic_diversity").alias("topic_diversity")))


def _model_row_sql():
    npmi = _coherence_sql(10, False) + """,
per AS (SELECT topic, avg(npmi) AS coherence FROM m GROUP BY topic)
SELECT avg(coherence) FROM per"""
    cv = _coherence_sql(110, True) + """,
s AS (SELECT topic, wj, sum(npmi) AS s FROM m GROUP BY topic, wj),
ns AS (SELECT topic, sqrt(sum(s * s)) AS ns FROM s GROUP BY topic),
pw AS (SELECT m.topic, m.wi, sum(m.npmi * s.s) AS dot, sqrt(sum(m.npmi * m.npmi)) AS nu
       FROM m JOIN s USING (topic, wj) GROUP BY m.topic, m.wi),
cs AS (SELECT pw.topic, dot / (nu * ns) AS cos FROM pw JOIN ns USING (topic)),
per AS (SELECT topic, avg(cos) AS coherence FROM cs GROUP BY topic)
SELECT avg(coherence) FROM per"""
    div = "WITH " + _ctfidf_sql().strip() + """
SELECT coalesce(count(DISTINCT term) / nullif(count(term), 0), 0) FROM top"""
    cnt = "WITH " + _prep_sql().strip() + """
SELECT count(DISTINCT CASE WHEN topic <> -1 THEN topic END) AS n_topics,
       avg(CASE WHEN topic = -1 THEN 1.0 ELSE 0.0 END) AS outlier_ratio FROM prep"""
    return f"""
WITH c AS ({cnt})
SELECT c.n_topics, round(c.outlier_ratio, 6) AS outlier_ratio, round(({cv}), 6) AS c_v,
       round(({npmi}), 6) AS c_npmi, round(({div}), 6) AS topic_diversity FROM c"""


query("topic_model_metrics", "F14, F16, F17, F18 (sensitivity row)", _model_row_sql())(model_row)
