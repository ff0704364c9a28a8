"""Driver queries for evaluation, significance, scoring jobs, joins and the
category roll-up (C*, D*, G*, H*).

Predictions come from simple rules over the driver tables so that every
number can be recomputed in SQL: ``lex_rule`` (test lexicon hit),
``long_rule`` (n_chars > 200), ``src_rule`` (doc_id % 3 = 0),
``lowq_rule`` (quality = 0); gold is ``labels.toxic``.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from textrisk.functions import text as T
from textrisk.functions.stats import wilson_interval
from textrisk.lexicons import TEST_LEXICON, prompt_templates
from textrisk.operators import categories as G
from textrisk.operators import evaluate as E
from textrisk.operators import joins as H
from textrisk.operators import scoring as C
from textrisk.operators import screen as S
from textrisk.operators.significance import mcnemar_pairs
from textrisk.plans import sqlfrag as Q
from textrisk.plans.registry import query
from textrisk.sources.readers import table

RULES = ["lex_rule", "long_rule", "src_rule", "lowq_rule"]
RULE_NAMES = {"lex_rule": "lexicon", "long_rule": "long text", "src_rule": "source rule",
              "lowq_rule": "low quality"}


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def lex_hit(text_col="text"):
    return (F.size(T.keyword_matches(T.null_to_empty(text_col), TEST_LEXICON)) > 0).cast("int")


def eval_frame(spark, sf):
    """labels joined to documents with the rule predictions (one row per label row)."""
    labels = table(spark, sf, "labels", ["doc_id", "quality", "toxic"])
    # The text rule is evaluated on the documents side, so a join that has
    # to shuffle moves (doc_id, flags), never the text itself.
    docs = (table(spark, sf, "documents", ["doc_id", "text", "n_chars", "source", "lang"])
            .select("doc_id", "n_chars", "source", "lang", lex_hit().alias("lex_rule")))
    j = labels.join(docs, "doc_id", "inner")
    return j.select("doc_id", "source", "lang", F.col("toxic").alias("gold"), "quality", "lex_rule",
                    F.when(F.col("n_chars") > 200, 1).otherwise(0).alias("long_rule"),
                    F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0).alias("src_rule"),
                    F.when(F.col("quality") == 0, 1).otherwise(0).alias("lowq_rule"))


_EV_SQL = f"""ev AS (
  SELECT l.doc_id, d.source, d.lang, l.toxic AS gold, l.quality,
         CASE WHEN len({Q.keyword_matches("coalesce(d.text, '')", TEST_LEXICON)}) > 0 THEN 1 ELSE 0 END AS lex_rule,
         CASE WHEN d.n_chars > 200 THEN 1 ELSE 0 END AS long_rule,
         CASE WHEN d.doc_id % 3 = 0 THEN 1 ELSE 0 END AS src_rule,
         CASE WHEN l.quality = 0 THEN 1 ELSE 0 END AS lowq_rule
  FROM labels l JOIN documents d USING (doc_id))"""


def _metrics_sql(tn="tn", fp="fp", fn="fn", tp="tp"):
    n = f"({tn} + {fp} + {fn} + {tp})"
    po = f"(({tp} + {tn}) / {n})"
    pe = f"((({tp} + {fp}) * ({tp} + {fn}) + ({tn} + {fn}) * ({tn} + {fp})) / ({n} * {n}))"
    return {
        "accuracy": po,
        "precision": f"(CASE WHEN {tp} + {fp} > 0 THEN {tp} / ({tp} + {fp}) ELSE 0 END)",
        "recall": f"(CASE WHEN {tp} + {fn} > 0 THEN {tp} / ({tp} + {fn}) ELSE 0 END)",
        "f1": f"(CASE WHEN 2 * {tp} + {fp} + {fn} > 0 THEN 2 * {tp} / (2 * {tp} + {fp} + {fn}) ELSE 0 END)",
        "kappa": f"(CASE WHEN {pe} <> 1 THEN ({po} - {pe}) / (1 - {pe}) END)",
    }


def _union_long(src, id_cols, models, label_expr=lambda m: m, extra=""):
    return " UNION ALL ".join(
        f"SELECT {id_cols}, '{m}' AS model, {label_expr(m)} AS label{extra} FROM {src}" for m in models)


# ------------------------------------------------------------------ D1
@query("label_prevalence", "D1, B14, C9", f"""
WITH l AS ({_union_long('labels', 'doc_id', ['quality', 'toxic'])})
SELECT model, count(*) FILTER (WHERE label = 1) AS positives, count(label) AS n,
       round(count(*) FILTER (WHERE label = 1) / nullif(count(label), 0), 6) AS share
FROM l GROUP BY model""")
def label_prevalence(spark, sf):
    labels = table(spark, sf, "labels", ["doc_id", "quality", "toxic"])
    long = E.to_long(labels, ["doc_id"], ["quality", "toxic"])
    return E.prevalence(long).withColumn("share", r6("share"))


# ------------------------------------------------------------------ D7
_DIST_SQL = f"""
WITH w AS (
  SELECT d.doc_id, l.toxic, l.quality,
         CASE WHEN len({Q.keyword_matches("coalesce(d.text, '')", TEST_LEXICON)}) > 0 THEN 1 ELSE 0 END AS lex_rule
  FROM documents d LEFT JOIN labels l USING (doc_id)),
l AS ({_union_long('w', 'doc_id', ['toxic', 'quality', 'lex_rule'])}),
a AS (SELECT model, count(*) FILTER (WHERE label = 1) AS risk, count(*) FILTER (WHERE label = 0) AS non_risk
      FROM l GROUP BY model)
SELECT model, risk, non_risk, risk + non_risk AS total,
       round(risk * 100 / nullif(risk + non_risk, 0), 6) AS risk_pct,
       round(non_risk * 100 / nullif(risk + non_risk, 0), 6) AS non_risk_pct FROM a"""


@query("label_distribution", "D7, A5", _DIST_SQL)
def label_distribution(spark, sf):
    docs = table(spark, sf, "documents", ["doc_id", "text"]).select("doc_id", lex_hit().alias("lex_rule"))
    labels = table(spark, sf, "labels", ["doc_id", "quality", "toxic"])
    w = docs.join(labels, "doc_id", "left").select("doc_id", "toxic", "quality", "lex_rule")
    out = E.label_distribution(E.to_long(w, ["doc_id"], ["toxic", "quality", "lex_rule"]))
    return out.withColumn("risk_pct", r6("risk_pct")).withColumn("non_risk_pct", r6("non_risk_pct"))


# ------------------------------------------------------------------ D2, D6
@query("confusion_toxic", "D2, D6", f"""
WITH {_EV_SQL},
l AS ({_union_long('ev', 'doc_id, gold', RULES[:3])}),
c AS (SELECT model, count(*) FILTER (WHERE gold = 0 AND label = 0) AS tn,
             count(*) FILTER (WHERE gold = 0 AND label = 1) AS fp,
             count(*) FILTER (WHERE gold = 1 AND label = 0) AS fn,
             count(*) FILTER (WHERE gold = 1 AND label = 1) AS tp FROM l GROUP BY model)
SELECT model, tn, fp, fn, tp,
       round(tn / nullif(tn + fp, 0), 6) AS tn_share, round(fp / nullif(tn + fp, 0), 6) AS fp_share,
       round(fn / nullif(fn + tp, 0), 6) AS fn_share, round(tp / nullif(fn + tp, 0), 6) AS tp_share
FROM c""")
def confusion_toxic(spark, sf):
    ev = eval_frame(spark, sf)
    long = E.to_long(ev.select("doc_id", "gold", *RULES[:3]), ["doc_id", "gold"], RULES[:3])
    out = E.confusion_normalised(E.confusion_counts(long, "gold", "label"))
    for c in ("tn_share", "fp_share", "fn_share", "tp_share"):
        out = out.withColumn(c, r6(c))
    return out


# ------------------------------------------------------------------ D3-D5, D8
def _model_metrics_sql():
    items = [(RULE_NAMES[r], r) for r in RULES] + [("All positive", "1")]
    body = " UNION ALL ".join(
        f"SELECT {i + 1} AS ord, '{name}' AS model, gold, {expr} AS label FROM ev"
        for i, (name, expr) in enumerate(items))
    m = _metrics_sql()
    return f"""
WITH {_EV_SQL},
l AS ({body}),
c AS (SELECT ord, model, count(*) FILTER (WHERE gold = 0 AND label = 0) AS tn,
             count(*) FILTER (WHERE gold = 0 AND label = 1) AS fp,
             count(*) FILTER (WHERE gold = 1 AND label = 0) AS fn,
             count(*) FILTER (WHERE gold = 1 AND label = 1) AS tp
      FROM l WHERE gold IS NOT NULL AND label IS NOT NULL GROUP BY ord, model)
SELECT ord, model, tn, fp, fn, tp, tn + fp + fn + tp AS n_used,
       {', '.join(f'round({v}, 6) AS {k}' for k, v in m.items())}
FROM c"""


@query("model_metrics", "D3, D4, D5, D8", _model_metrics_sql())
def model_metrics(spark, sf):
    ev = eval_frame(spark, sf)
    out = E.metrics_table(ev, "gold", [(RULE_NAMES[r], r) for r in RULES])
    for c in ("accuracy", "precision", "recall", "f1", "kappa"):
        out = out.withColumn(c, r6(c))
    return out


# ------------------------------------------------------------------ D4 (K classes), G1
def _kappa_sql(src, a, b):
    return f"""
WITH e AS (SELECT {a} AS a, {b} AS b FROM {src}),
cells AS (SELECT a, b, count(*) AS c FROM e WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY a, b),
tot AS (SELECT sum(c) AS n, sum(CASE WHEN a = b THEN c ELSE 0 END) AS agree FROM cells),
ra AS (SELECT a AS k, sum(c) AS r FROM cells GROUP BY a),
cb AS (SELECT b AS k, sum(c) AS r FROM cells GROUP BY b),
pe AS (SELECT coalesce(sum(ra.r * cb.r), 0) AS num FROM ra JOIN cb USING (k)),
v AS (SELECT n, agree / n AS po, num / (n * n) AS pe FROM tot, pe)
SELECT CAST(n AS BIGINT) AS n_used, round(po, 6) AS po, round(pe, 6) AS pe,
       round(CASE WHEN pe <> 1 THEN (po - pe) / (1 - pe) END, 6) AS kappa FROM v"""


@query("kappa_multiclass", "D4", _kappa_sql("embeddings", "label", "CAST(vec_id % 10 AS INTEGER)"))
def kappa_multiclass(spark, sf):
    emb = table(spark, sf, "embeddings", ["vec_id", "label"])
    df = emb.select("label", (F.col("vec_id") % 10).cast("int").alias("rater_b"))
    out = E.kappa_table(df, "label", "rater_b")
    return out.select("n_used", r6("po").alias("po"), r6("pe").alias("pe"), r6("kappa").alias("kappa"))


# ------------------------------------------------------------------ D9-D12
PAIRS = list(combinations(RULES, 2))


def _mcnemar_sql():
    parts = []
    for i, (a, b) in enumerate(PAIRS):
        parts.append(f"""SELECT {i + 1} AS pair_no, '{a}' AS model_a, '{b}' AS model_b,
  count(*) FILTER (WHERE {a} = gold AND {b} = gold) AS both_correct,
  count(*) FILTER (WHERE {a} = gold AND {b} <> gold) AS a_only_correct,
  count(*) FILTER (WHERE {a} <> gold AND {b} = gold) AS b_only_correct,
  count(*) FILTER (WHERE {a} <> gold AND {b} <> gold) AS both_wrong FROM ev""")
    p = ("least(1.0, 2.0 * list_sum(list_transform(range(0, least(a_only_correct, b_only_correct) + 1), "
         "lambda i: exp(lgamma(a_only_correct + b_only_correct + 1) - lgamma(i + 1) "
         "- lgamma(a_only_correct + b_only_correct - i + 1) + (a_only_correct + b_only_correct) * ln(0.5)))))")
    return f"""
WITH {_EV_SQL},
d AS ({' UNION ALL '.join(parts)}),
p AS (SELECT *, {p} AS p FROM d)
SELECT pair_no, model_a, model_b, both_correct, a_only_correct, b_only_correct, both_wrong,
       round(p, 6) AS p_value,
       CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'n.s.' END AS sig
FROM p"""


@query("mcnemar_pairs", "D9, D10, D11, D12", _mcnemar_sql())
def mcnemar_pairs_q(spark, sf):
    ev = eval_frame(spark, sf)
    return mcnemar_pairs(ev, "gold", PAIRS).withColumn("p_value", r6("p_value"))


# ------------------------------------------------------------------ D13, D14
RUNS = ["toxic", "quality", "lex_rule", "long_rule"]
RUN_PAIRS = list(combinations(RUNS, 2))


def _agreement_sql():
    parts = []
    for i, (a, b) in enumerate(RUN_PAIRS):
        cells = ", ".join(
            f"count(*) FILTER (WHERE {a} = {x} AND {b} = {y}) AS c{x}{y}" for x in (0, 1) for y in (0, 1))
        parts.append(f"SELECT {i + 1} AS pair_no, '{a}' AS run_a, '{b}' AS run_b, {cells} FROM w")
    m = _metrics_sql("c00", "c01", "c10", "c11")
    return f"""
WITH w AS (
  SELECT d.doc_id, l.toxic, l.quality,
         CASE WHEN len({Q.keyword_matches("coalesce(d.text, '')", TEST_LEXICON)}) > 0 THEN 1 ELSE 0 END AS lex_rule,
         CASE WHEN d.n_chars > 200 THEN 1 ELSE 0 END AS long_rule
  FROM documents d LEFT JOIN labels l USING (doc_id)),
c AS ({' UNION ALL '.join(parts)})
SELECT pair_no, run_a, run_b, c00 + c01 + c10 + c11 AS n_used,
       round((c00 + c11) / nullif(c00 + c01 + c10 + c11, 0), 6) AS agreement,
       c01 + c10 AS n_changed, round({m['kappa']}, 6) AS kappa
FROM c"""


@query("agreement_pairs", "D13, D14, C8", _agreement_sql())
def agreement_pairs(spark, sf):
    docs = table(spark, sf, "documents", ["doc_id", "text", "n_chars"]).select(
        "doc_id", lex_hit().alias("lex_rule"), F.when(F.col("n_chars") > 200, 1).otherwise(0).alias("long_rule"))
    labels = table(spark, sf, "labels", ["doc_id", "quality", "toxic"])
    w = docs.join(labels, "doc_id", "left").select("doc_id", "toxic", "quality", "lex_rule", "long_rule")
    out = E.pairwise_agreement(w, RUN_PAIRS)
    return out.withColumn("agreement", r6("agreement")).withColumn("kappa", r6("kappa"))


# ------------------------------------------------------------------ D15
def _wilson_sql(k, n):
    z = 1.959963984540054
    z2 = z * z
    p = f"({k} / {n})"
    den = f"(1 + {z2!r} / {n})"
    center = f"(({p} + {z2!r} / (2 * {n})) / {den})"
    half = f"({z!r} * sqrt({p} * (1 - {p}) / {n} + {z2!r} / (4 * {n} * {n})) / {den})"
    return f"round({center} - {half}, 6)", f"round({center} + {half}, 6)"


def _wilson_by_source_sql():
    lo, hi = _wilson_sql("positives", "n")
    return f"""
WITH {_EV_SQL},
a AS (SELECT source, count(*) FILTER (WHERE gold = 1) AS positives, count(gold) AS n FROM ev GROUP BY source)
SELECT source, positives, n, round(positives / nullif(n, 0), 6) AS share, {lo} AS ci_low, {hi} AS ci_high FROM a"""


@query("wilson_by_source", "D15", _wilson_by_source_sql())
def wilson_by_source(spark, sf):
    ev = eval_frame(spark, sf)
    a = ev.groupBy("source").agg(F.count_if(F.col("gold") == 1).alias("positives"), F.count("gold").alias("n"))
    lo, hi = wilson_interval("positives", "n")
    return a.select("source", "positives", "n", r6(F.try_divide(F.col("positives").cast("double"), F.col("n")))
                    .alias("share"), r6(lo).alias("ci_low"), r6(hi).alias("ci_high"))


# ------------------------------------------------------------------ G7
def _coverage_sql():
    lo, hi = _wilson_sql("positives", "n")
    return f"""
WITH {Q.screen_base('documents', 'doc_id', 'doc_id').strip()},
  ex AS (SELECT doc_id FROM base WHERE len({Q.keyword_matches('text', TEST_LEXICON)}) = 0
         ORDER BY md5(CAST(doc_id AS VARCHAR) || '-' || '42'), doc_id LIMIT 100),
  s AS (SELECT ex.doc_id, l.toxic FROM ex LEFT JOIN labels l USING (doc_id)),
  a AS (SELECT count(*) AS n_sampled, count(toxic) AS n, count(*) FILTER (WHERE toxic = 1) AS positives FROM s)
SELECT n_sampled, n, positives, round(positives / nullif(n, 0), 6) AS share, {lo} AS ci_low, {hi} AS ci_high FROM a"""


@query("coverage_audit", "G7, B12, B13, D1, D15", _coverage_sql())
def coverage_audit(spark, sf):
    docs = table(spark, sf, "documents", ["doc_id", "text"])
    sample = S.sample_for_audit(S.screen_excluded(docs, "text", "doc_id", TEST_LEXICON), "doc_id", 100)
    labels = table(spark, sf, "labels", ["doc_id", "toxic"])
    s = sample.select("doc_id").join(labels, "doc_id", "left")
    out = G.coverage_audit(s, "toxic")
    return out.select("n_sampled", "n", "positives", r6("share").alias("share"),
                      r6("ci_low").alias("ci_low"), r6("ci_high").alias("ci_high"))


# ------------------------------------------------------------------ D16
METRICS = ["accuracy", "precision", "recall", "f1", "kappa"]


def _mean_sd_sql():
    m = _metrics_sql()
    per = ", ".join(f"{v} AS {k}" for k, v in m.items())
    un = " UNION ALL ".join(f"SELECT source, '{k}' AS metric, {k} AS value FROM ps" for k in METRICS)
    return f"""
WITH {_EV_SQL},
c AS (SELECT source, count(*) FILTER (WHERE gold = 0 AND lex_rule = 0) AS tn,
             count(*) FILTER (WHERE gold = 0 AND lex_rule = 1) AS fp,
             count(*) FILTER (WHERE gold = 1 AND lex_rule = 0) AS fn,
             count(*) FILTER (WHERE gold = 1 AND lex_rule = 1) AS tp FROM ev WHERE gold IS NOT NULL GROUP BY source),
ps AS (SELECT source, {per} FROM c),
l AS ({un})
SELECT metric, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, count(value) AS n FROM l GROUP BY metric"""


@query("metric_mean_sd", "D16", _mean_sd_sql())
def metric_mean_sd(spark, sf):
    ev = eval_frame(spark, sf).where(F.col("gold").isNotNull())
    per = E.with_binary_metrics(E.confusion_counts(ev, "gold", "lex_rule", ["source"]))
    long = E.to_long(per.select("source", *METRICS), ["source"], METRICS, "metric", "value")
    out = E.mean_sd(long, ["metric"], "value")
    return out.select("metric", r6("mean").alias("mean"), r6("sd").alias("sd"), "n")


# ------------------------------------------------------------------ C6, C7, C9, H4
@query("scoring_pending", "C6, C7, C9, H4", f"""
WITH plan AS (SELECT d.doc_id AS row_id, m.model, 1 AS run FROM documents d
              CROSS JOIN (VALUES ('quality'), ('toxic')) m(model)),
store AS ({_union_long('labels', 'doc_id AS row_id', ['quality', 'toxic'], extra=', 1 AS run')})
SELECT p.row_id, p.model, p.run FROM plan p
WHERE NOT EXISTS (SELECT 1 FROM store s WHERE s.row_id = p.row_id AND s.model = p.model
                  AND s.run = p.run AND s.label IS NOT NULL)""")
def scoring_pending(spark, sf):
    rows = table(spark, sf, "documents", ["doc_id"]).withColumnRenamed("doc_id", "row_id")
    plan = C.scoring_plan(rows, ["quality", "toxic"], runs=[1])
    labels = table(spark, sf, "labels", ["doc_id", "quality", "toxic"]).withColumnRenamed("doc_id", "row_id")
    store = E.to_long(labels, ["row_id"], ["quality", "toxic"]).withColumn("run", F.lit(1))
    return C.pending_rows(plan, store).select("row_id", "model", "run")


# ------------------------------------------------------------------ C1, C8, H5
def _prompt_sql():
    tmpl = ", ".join(f"({Q.lit(n)}, {Q.lit(t)})" for n, t in prompt_templates())
    plan = ", ".join(f"({Q.lit(n)}, {r})" for n, r in C.VARIANT_PLAN)
    return f"""
WITH t(name, template) AS (VALUES {tmpl}),
v(variant, run) AS (VALUES {plan}),
vt AS (SELECT v.variant, v.run, t.template FROM v JOIN t ON v.variant = t.name),
r AS (SELECT c.conv_id, c.turn, vt.variant, vt.run, replace(vt.template, '{{tweet}}', coalesce(c.text, '')) AS prompt
      FROM conversations c CROSS JOIN vt)
SELECT conv_id, turn, variant, run, CAST(length(prompt) AS BIGINT) AS prompt_chars, md5(prompt) AS prompt_md5 FROM r"""


@query("prompt_render", "C1, C8, H5, A3", _prompt_sql())
def prompt_render(spark, sf):
    conv = (table(spark, sf, "conversations", ["conv_id", "turn", "role", "text"])
            .withColumn("text", T.null_to_empty("text")))
    out = C.variant_plan(conv.select("conv_id", "turn", "text"), "text")
    return out.select("conv_id", "turn", "variant", "run", F.length("prompt").cast("long").alias("prompt_chars"),
                      F.md5("prompt").alias("prompt_md5"))


# ------------------------------------------------------------------ C2-C5 (offline scorer)
@query("score_offline", "C2, C3, C4, C5", f"""
SELECT doc_id AS row_id, 'lexicon' AS model, 1 AS run,
       CASE WHEN len({Q.keyword_matches("coalesce(text, '')", TEST_LEXICON)}) > 0 THEN 1 ELSE 0 END AS label,
       NULL::VARCHAR AS error
FROM documents""")
def score_offline(spark, sf):
    rows = table(spark, sf, "documents", ["doc_id", "text"]).select(
        F.col("doc_id").alias("row_id"), T.null_to_empty("text").alias("text"))
    plan = C.scoring_plan(rows, ["lexicon"])
    store = spark.createDataFrame([], "row_id long, model string, run int, label int")
    tmpl = dict(prompt_templates())["primary_prompt"]
    # Keys first; only rows that are left get their prompt.
    pending = C.pending_rows(plan, store).withColumn("prompt", C.render_prompt(F.lit(tmpl), F.col("text")))
    scored = C.score(pending, {"lexicon": C.get_scorer_factory("lexicon")}, pause=0.0, batch_size=64)
    return scored.select("row_id", "model", "run", "label", "error")


# ------------------------------------------------------------------ H1
@query("rehydrate", "H1", """
SELECT l.doc_id, l.quality, l.toxic, d.lang, d.n_chars, d.text
FROM labels l LEFT JOIN documents d USING (doc_id)""")
def rehydrate(spark, sf):
    labels = table(spark, sf, "labels", ["doc_id", "quality", "toxic"])
    docs = table(spark, sf, "documents", ["doc_id", "lang", "n_chars", "text"])
    return H.rehydrate(labels, docs, "doc_id", ["lang", "n_chars", "text"])


# ------------------------------------------------------------------ G1-G6
def topic_table(spark, sf):
    """Topics from `embeddings.label` (label 0 = outliers, -1) with sizes and a
    derived two-coder category mapping of every topic."""
    emb = table(spark, sf, "embeddings", ["vec_id", "label"])
    docs = emb.select("vec_id", F.when(F.col("label") == 0, -1).otherwise(F.col("label")).alias("topic"))
    sizes = docs.groupBy("topic").agg(F.count(F.lit(1)).alias("n_docs"))
    t = F.col("topic")
    mapping = (sizes.where(t != -1)
               .select("topic", "n_docs",
                       (t % 5 + 1).cast("int").alias("category"),
                       (t % 5 + 1).cast("int").alias("label_a"),
                       F.when(t % 4 == 0, t % 3 + 1).otherwise(t % 5 + 1).cast("int").alias("label_b")))
    return docs, sizes, mapping


_TOPIC_SQL = """
docs AS (SELECT vec_id, CASE WHEN label = 0 THEN -1 ELSE label END AS topic FROM embeddings),
sizes AS (SELECT topic, count(*) AS n_docs FROM docs GROUP BY topic),
mapping AS (SELECT topic, n_docs, CAST(topic % 5 + 1 AS INTEGER) AS category,
                   CAST(topic % 5 + 1 AS INTEGER) AS label_a,
                   CAST(CASE WHEN topic % 4 = 0 THEN topic % 3 + 1 ELSE topic % 5 + 1 END AS INTEGER) AS label_b
            FROM sizes WHERE topic <> -1)"""


@query("category_rollup", "G2, G3, H3", f"""
WITH {_TOPIC_SQL.strip()},
names(category, category_name) AS (VALUES (1, 'Technical safety'), (2, 'Privacy and data misuse'),
  (3, 'Fairness and discrimination'), (4, 'Malicious misuse'), (5, 'Societal and democratic risks')),
a AS (SELECT category, count(topic) AS n_topics, CAST(sum(n_docs) AS BIGINT) AS n_documents FROM mapping GROUP BY category)
SELECT a.category, n_topics, n_documents,
       round(n_documents * 100 / sum(n_documents) OVER (), 6) AS share_pct, names.category_name
FROM a LEFT JOIN names USING (category)""")
def category_rollup(spark, sf):
    _, _, mapping = topic_table(spark, sf)
    out = G.category_rollup(mapping)
    return out.select("category", "n_topics", "n_documents", r6("share_pct").alias("share_pct"), "category_name")


@query("top_topics_per_category", "G4", f"""
WITH {_TOPIC_SQL.strip()}
SELECT category, topic, n_docs, rank FROM (
  SELECT category, topic, n_docs, row_number() OVER (PARTITION BY category ORDER BY n_docs DESC, topic) AS rank
  FROM mapping) WHERE rank <= 3""")
def top_topics_per_category(spark, sf):
    _, _, mapping = topic_table(spark, sf)
    return (G.top_topics_per_category(mapping, 3)
            .select("category", "topic", "n_docs", F.col("rank").cast("long").alias("rank")))


@query("topic_coder_kappa", "G1", _kappa_sql(f"(WITH {_TOPIC_SQL.strip()} SELECT * FROM mapping)",
                                             "label_a", "label_b"))
def topic_coder_kappa(spark, sf):
    _, _, mapping = topic_table(spark, sf)
    out = G.coder_agreement(mapping)
    return out.select("n_used", r6("po").alias("po"), r6("pe").alias("pe"), r6("kappa").alias("kappa"))


@query("category_violations", "G5", f"""
WITH {_TOPIC_SQL.strip()},
counts AS (SELECT topic, count(DISTINCT category) AS n_categories FROM mapping
           WHERE topic NOT IN (-1, 9) GROUP BY topic)
SELECT topic, n_categories, 'multiple_categories' AS problem FROM counts WHERE n_categories > 1
UNION ALL
SELECT DISTINCT d.topic, CAST(0 AS BIGINT), 'unmapped' FROM docs d
WHERE d.topic <> -1 AND NOT EXISTS (SELECT 1 FROM counts c WHERE c.topic = d.topic)""")
def category_violations(spark, sf):
    docs, _, mapping = topic_table(spark, sf)
    mapping = mapping.where(F.col("topic") != 9)  # left unmapped here, to be reported
    return G.category_violations(docs, mapping).select("topic", "n_categories", "problem")


@query("coder_disagreements", "G6", f"""
WITH {_TOPIC_SQL.strip()}
SELECT topic, label_a, label_b, category FROM mapping WHERE label_a <> label_b""")
def coder_disagreements(spark, sf):
    _, _, mapping = topic_table(spark, sf)
    return G.coder_disagreements(mapping).select("topic", "label_a", "label_b", "category")
