"""Driver queries for screening (B*) and the scoring job (C*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from textrisk.lexicons import KEYWORD_STEMS, TEST_LEXICON
from textrisk.operators import screen as S
from textrisk.plans import sqlfrag as Q
from textrisk.plans.registry import query
from textrisk.sources.readers import table


def _candidates(spark, sf, stems):
    docs = table(spark, sf, "documents", ["doc_id", "text", "lang", "source"])
    out = S.screen(docs, "text", "doc_id", stems)
    return out.select("doc_id", "lang", "source", "text",
                      F.array_join("matched_keywords", "|").alias("matched_keywords"),
                      F.size("matched_keywords").cast("long").alias("n_matches"))


def _candidates_sql(stems):
    return f"""
WITH {Q.screen_base('documents', 'doc_id, lang, source', 'doc_id').strip()},
  m AS (SELECT *, {Q.keyword_matches('text', stems)} AS kws FROM base)
SELECT doc_id, lang, source, text, array_to_string(kws, '|') AS matched_keywords,
       CAST(len(kws) AS BIGINT) AS n_matches
FROM m WHERE len(kws) > 0"""


@query("screen_candidates", "B3-B10", _candidates_sql(TEST_LEXICON))
def screen_candidates(spark, sf):
    """Candidates of the whole `documents` table under the test lexicon."""
    return _candidates(spark, sf, TEST_LEXICON)


@query("screen_candidates_stems", "B3-B10", _candidates_sql(KEYWORD_STEMS))
def screen_candidates_stems(spark, sf):
    """Same screening with the 38 published stems."""
    return _candidates(spark, sf, KEYWORD_STEMS)


_FUNNEL_SQL = f"""
WITH t AS (SELECT coalesce(text, '') AS t, count(*) AS n FROM documents GROUP BY 1),
f AS (SELECT n, {Q.is_url_only('t')} AS url, {Q.word_count('t')} >= 5 AS long,
             len({Q.keyword_matches(Q.rewrite('t'), TEST_LEXICON)}) > 0 AS hit FROM t),
a AS (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS loaded,
             CAST(coalesce(sum(CASE WHEN url THEN n ELSE 0 END), 0) AS BIGINT) AS url_only,
             CAST(coalesce(sum(CASE WHEN NOT url THEN n - 1 ELSE 0 END), 0) AS BIGINT) AS duplicates,
             CAST(count(*) FILTER (WHERE NOT url AND NOT long) AS BIGINT) AS short,
             CAST(count(*) FILTER (WHERE NOT url AND long AND NOT hit) AS BIGINT) AS no_keyword,
             CAST(count(*) FILTER (WHERE NOT url AND long AND hit) AS BIGINT) AS candidates FROM f),
s AS (
  SELECT 1 AS stage_no, 'loaded' AS stage, 0 AS removed, loaded AS remaining FROM a UNION ALL
  SELECT 2, 'basic_cleaning', 0, loaded FROM a UNION ALL
  SELECT 3, 'url_only_removed', url_only, loaded - url_only FROM a UNION ALL
  SELECT 4, 'duplicates_removed', duplicates, loaded - url_only - duplicates FROM a UNION ALL
  SELECT 5, 'short_removed', short, loaded - url_only - duplicates - short FROM a UNION ALL
  SELECT 6, 'symbols_stripped', 0, loaded - url_only - duplicates - short FROM a UNION ALL
  SELECT 7, 'keyword_filtered', no_keyword, candidates FROM a)
SELECT CAST(stage_no AS BIGINT) AS stage_no, stage, CAST(removed AS BIGINT) AS removed,
       CAST(remaining AS BIGINT) AS remaining,
       CASE WHEN stage_no = 7 THEN round(candidates * 100.0 / nullif(loaded - url_only - duplicates - short, 0), 6) END AS keep_pct
FROM s, a"""


@query("screen_funnel", "B11", _FUNNEL_SQL)
def screen_funnel(spark, sf):
    docs = table(spark, sf, "documents", ["text"])
    return S.screen_funnel(docs, "text", TEST_LEXICON)


# The synthetic conversation turns hold no domain words; two common stems
# exercise the same stages on a second table.
CONV_STEMS = ["that", "this"]

_CONV_SQL = f"""
WITH {Q.screen_base('conversations', 'conv_id, turn, role', 'conv_id, turn').strip()},
  m AS (SELECT *, {Q.keyword_matches('text', CONV_STEMS)} AS kws FROM base)
SELECT conv_id, turn, role, text, array_to_string(kws, '|') AS matched_keywords,
       CAST(len(kws) AS BIGINT) AS n_matches
FROM m WHERE len(kws) > 0"""


@query("screen_conversations", "B4-B10", _CONV_SQL)
def screen_conversations(spark, sf):
    conv = table(spark, sf, "conversations", ["conv_id", "turn", "role", "text"])
    out = S.screen(conv, "text", ["conv_id", "turn"], CONV_STEMS)
    return out.select("conv_id", "turn", "role", "text",
                      F.array_join("matched_keywords", "|").alias("matched_keywords"),
                      F.size("matched_keywords").cast("long").alias("n_matches"))


_EXCLUDED_SQL = f"""
WITH {Q.screen_base('documents', 'doc_id, lang, source', 'doc_id').strip()},
  m AS (SELECT * FROM base WHERE len({Q.keyword_matches('text', TEST_LEXICON)}) = 0)
SELECT doc_id, lang, source, text FROM m
ORDER BY md5(CAST(doc_id AS VARCHAR) || '-' || '42'), doc_id LIMIT 100"""


@query("screen_excluded_sample", "B12-B13", _EXCLUDED_SQL)
def screen_excluded_sample(spark, sf):
    docs = table(spark, sf, "documents", ["doc_id", "text", "lang", "source"])
    excl = S.screen_excluded(docs, "text", "doc_id", TEST_LEXICON)
    return S.sample_for_audit(excl, "doc_id", 100, seed=42).select("doc_id", "lang", "source", "text")


_KW_LANG_SQL = f"""
WITH {Q.screen_base('documents', 'doc_id, lang', 'doc_id').strip()},
  m AS (SELECT doc_id, lang, unnest({Q.keyword_matches('text', TEST_LEXICON)}) AS keyword FROM base)
SELECT lang, keyword, count(*) AS hits, count(DISTINCT doc_id) AS docs FROM m GROUP BY lang, keyword"""


@query("keyword_by_lang", "B10, B15", _KW_LANG_SQL)
def keyword_by_lang(spark, sf):
    docs = table(spark, sf, "documents", ["doc_id", "text", "lang"])
    cands = S.screen(docs, "text", "doc_id", TEST_LEXICON)
    return (cands.select("doc_id", "lang", F.explode("matched_keywords").alias("keyword"))
            .groupBy("lang", "keyword")
            .agg(F.count(F.lit(1)).alias("hits"), F.countDistinct("doc_id").alias("docs")))


_BY_LANG_SQL = f"""
WITH {Q.screen_base('documents', 'doc_id, lang', 'doc_id').strip()},
  m AS (SELECT lang, len({Q.keyword_matches('text', TEST_LEXICON)}) AS k FROM base)
SELECT lang, count(*) AS screened, count(*) FILTER (WHERE k > 0) AS candidates,
       CAST(sum(k) AS BIGINT) AS keyword_hits FROM m GROUP BY lang"""


def screen_by_lang_df(spark, sf):
    docs = table(spark, sf, "documents", ["doc_id", "text", "lang"])
    base = S.with_keyword_matches(S.screen_base(docs, "text", "doc_id"), "text", TEST_LEXICON)
    k = F.size("matched_keywords")
    return base.groupBy("lang").agg(
        F.count(F.lit(1)).alias("screened"),
        F.count_if(k > 0).alias("candidates"),
        F.sum(k).cast("long").alias("keyword_hits"))


query("screen_by_lang", "B3-B10 (flagship)", _BY_LANG_SQL)(screen_by_lang_df)


@query("stream_screen_candidates", "B3-B10 as Structured Streaming (availableNow)", _candidates_sql(TEST_LEXICON))
def stream_screen_candidates(spark, sf):
    """The screening run as a stream over the `documents` files: every file
    not yet processed is screened, then the job stops. Each build uses a
    fresh output folder under the shared checkpoint folder."""
    import os
    import uuid

    from textrisk.session import checkpoint_dir
    from textrisk.streaming.screen_stream import screen_stream
    src = os.path.join(sf, "documents.parquet")
    schema = spark.read.parquet(src).select("doc_id", "text", "lang", "source").schema
    out = os.path.join(checkpoint_dir(spark), f"stream-documents-{uuid.uuid4().hex}")
    cand, _ = screen_stream(spark, src, schema, "text", "doc_id", out, TEST_LEXICON, "documents")
    res = spark.read.parquet(cand)
    return res.select("doc_id", "lang", "source", "text",
                      F.array_join("matched_keywords", "|").alias("matched_keywords"),
                      F.size("matched_keywords").cast("long").alias("n_matches"))
