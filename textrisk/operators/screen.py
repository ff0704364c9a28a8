"""Keyword pre-screening of raw text rows (operators B1-B15).

Order of the stages matters and follows the published screening: URL-only
rows out, exact-duplicate texts out (first in file order kept), fewer than
five words out -- all on the raw text -- then the symbol strip and the dash
replacement, then the keyword match on the rewritten text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textrisk.functions import text as T
from textrisk.lexicons import KEYWORD_STEMS
from textrisk.schema import require_columns


# Date forms besides ISO, tried in this order; a leading weekday name is dropped first.
# 01/04/2023 is read month first.
DATE_FORMS = ("MMM dd HH:mm:ss Z yyyy", "M/d/yyyy", "d MMM yyyy", "MMM d, yyyy", "yyyy/M/d HH:mm", "yyyy/M/d")


def coerce_date(c: Column | str) -> Column:
    """Parse to a timestamp (session time zone UTC), keep the date; bad -> null."""
    c = (F.col(c) if isinstance(c, str) else c).cast("string")
    plain = F.regexp_replace(F.trim(c), "^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun),? ", "")
    return F.to_date(F.coalesce(F.try_to_timestamp(c), *[F.try_to_timestamp(plain, F.lit(f)) for f in DATE_FORMS]))


def prepare(df: DataFrame, text_col: str, date_col: str | None = None,
            fill_cols: Sequence[str] = ()) -> DataFrame:
    """B2 + B3: dates coerced, text (and ``fill_cols``) null -> ''."""
    out = df.withColumn(text_col, T.null_to_empty(text_col))
    for c in fill_cols:
        out = out.withColumn(c, T.null_to_empty(F.col(c).cast("string")))
    if date_col:
        out = out.withColumn(date_col, coerce_date(date_col))
    return out


def drop_url_only(df: DataFrame, text_col: str) -> DataFrame:
    """Remove rows that are a single http(s)/www token (case-insensitive)."""
    return df.where(~T.is_url_only(F.col(text_col)))


def dedup_first(df: DataFrame, key_cols: Sequence[str], order_col: str | Sequence[str]) -> DataFrame:
    """One row per key, the one with the smallest ``order_col``.

    ``min_by`` is an aggregate, so duplicates collapse map-side before the
    single shuffle on the key: a hot text held by a third of the rows leaves
    at most one row per map task.
    """
    others = [c for c in df.columns if c not in key_cols]
    order = (F.col(order_col) if isinstance(order_col, str)
             else F.struct(*[F.col(c) for c in order_col]))
    kept = df.groupBy(*key_cols).agg(
        F.min_by(F.struct(*[F.col(c) for c in others]), order).alias("_first"))
    return kept.select(*key_cols, *[F.col("_first")[c].alias(c) for c in others]).select(*df.columns)


def min_words(df: DataFrame, text_col: str, n: int = 5) -> DataFrame:
    """Keep rows with at least ``n`` whitespace words (raw text)."""
    return df.where(T.has_min_words(F.col(text_col), n))


def rewrite_text(df: DataFrame, text_col: str) -> DataFrame:
    """B7 + B8: symbol strip, then dashes to spaces."""
    return df.withColumn(text_col, T.dashes_to_space(T.strip_symbols(F.col(text_col))))


def with_keyword_matches(df: DataFrame, text_col: str, stems: Sequence[str] = KEYWORD_STEMS,
                         out_col: str = "matched_keywords") -> DataFrame:
    """All matches, lower-cased, in text order (regex evaluated once)."""
    return df.withColumn(out_col, T.keyword_matches(F.col(text_col), stems))


def keyword_filter(df: DataFrame, text_col: str, stems: Sequence[str] = KEYWORD_STEMS,
                   out_col: str = "matched_keywords") -> DataFrame:
    """B9 + B10: keep rows with at least one match, carrying the match list."""
    return with_keyword_matches(df, text_col, stems, out_col).where(F.size(out_col) > 0)


def screen_base(df: DataFrame, text_col: str, order_col: str | Sequence[str],
                date_col: str | None = None, dedup_keys: Sequence[str] | None = None) -> DataFrame:
    """Rows that reach the keyword stage."""
    order_cols = [order_col] if isinstance(order_col, str) else list(order_col)
    require_columns(df, [text_col, *order_cols] + ([date_col] if date_col else []))
    out = prepare(df, text_col, date_col)
    out = drop_url_only(out, text_col)
    out = dedup_first(out, list(dedup_keys or [text_col]), order_col)
    out = min_words(out, text_col)
    return rewrite_text(out, text_col)


def screen(df: DataFrame, text_col: str, order_col: str | Sequence[str], stems: Sequence[str] = KEYWORD_STEMS,
           date_col: str | None = None) -> DataFrame:
    """The full pre-screening: candidates with ``matched_keywords``."""
    return keyword_filter(screen_base(df, text_col, order_col, date_col), text_col, stems)


def screen_excluded(df: DataFrame, text_col: str, order_col: str | Sequence[str],
                    stems: Sequence[str] = KEYWORD_STEMS) -> DataFrame:
    """Rows that reach the keyword stage and match nothing."""
    base = with_keyword_matches(screen_base(df, text_col, order_col), text_col, stems)
    return base.where(F.size("matched_keywords") == 0).drop("matched_keywords")


def sample_for_audit(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """A repeatable random sample of ``n`` rows.

    Ordered by md5(id || '-' || seed); Spark plans it as a per-task top-n
    (TakeOrderedAndProject), so no full sort and no skew.
    """
    key = F.md5(F.concat(F.col(id_col).cast("string"), F.lit("-"), F.lit(str(seed))))
    return df.withColumn("_k", key).orderBy("_k", id_col).limit(n).drop("_k")


def screen_funnel(df: DataFrame, text_col: str, stems: Sequence[str] = KEYWORD_STEMS) -> DataFrame:
    """Rows removed and remaining at every stage, one row per stage.

    Everything after the URL filter is a function of the text alone, so the
    table is first reduced to one row per distinct text (one shuffle with
    map-side combine), then a single global aggregate gives every count.
    """
    t = T.null_to_empty(F.col(text_col)).alias("_t")
    per_text = (df.select(t)
                .groupBy("_t").agg(F.count(F.lit(1)).alias("_rows"))
                .withColumn("_url", T.is_url_only(F.col("_t")))
                .withColumn("_long", T.has_min_words(F.col("_t"), 5))
                .withColumn("_hit", F.size(T.keyword_matches(
                    T.dashes_to_space(T.strip_symbols(F.col("_t"))), stems)) > 0))
    tot = per_text.agg(
        F.sum("_rows").alias("loaded"),
        F.sum(F.when(F.col("_url"), F.col("_rows")).otherwise(0)).alias("url_only"),
        F.sum(F.when(~F.col("_url"), F.col("_rows") - 1).otherwise(0)).alias("duplicates"),
        F.count_if(~F.col("_url") & ~F.col("_long")).alias("short"),
        F.count_if(~F.col("_url") & F.col("_long") & ~F.col("_hit")).alias("no_keyword"),
        F.count_if(~F.col("_url") & F.col("_long") & F.col("_hit")).alias("candidates"),
    ).select(*[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in
               ["loaded", "url_only", "duplicates", "short", "no_keyword", "candidates"]])
    stages = F.expr(
        "stack(7, "
        "1L, 'loaded', 0L, loaded, "
        "2L, 'basic_cleaning', 0L, loaded, "
        "3L, 'url_only_removed', url_only, loaded - url_only, "
        "4L, 'duplicates_removed', duplicates, loaded - url_only - duplicates, "
        "5L, 'short_removed', short, loaded - url_only - duplicates - short, "
        "6L, 'symbols_stripped', 0L, loaded - url_only - duplicates - short, "
        "7L, 'keyword_filtered', no_keyword, candidates"
        ") AS (stage_no, stage, removed, remaining)")
    kept = F.when(F.col("stage_no") == 7, F.round(
        F.try_divide(F.col("candidates") * 100.0, F.col("before_kw").cast("double")), 6))
    return (tot.withColumn("before_kw", F.col("loaded") - F.col("url_only") - F.col("duplicates") - F.col("short"))
            .select(stages, "candidates", "before_kw")
            .select("stage_no", "stage", "removed", "remaining", kept.alias("keep_pct")))


def filter_label(df: DataFrame, label_col: str, value: int = 1) -> DataFrame:
    """The rows with this label (null labels are not kept)."""
    return df.where(F.col(label_col) == value)
