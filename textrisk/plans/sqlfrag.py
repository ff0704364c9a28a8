"""DuckDB fragments for the oracle statements, built from the same pattern
bodies the Spark expressions use (textrisk.functions.text)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from textrisk.functions import text as T


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def str_list(words: Iterable[str]) -> str:
    return "[" + ", ".join(lit(w) for w in words) + "]"


def is_url_only(x: str) -> str:
    return f"regexp_matches({x}, {lit(T.duck_ci(T.URL_ONLY_BODY))})"


def word_count(x: str) -> str:
    return (f"CAST(len(list_filter(regexp_split_to_array({x}, {lit('[' + T.WS + ']+')}), "
            f"lambda w: w <> '')) AS BIGINT)")


def rewrite(x: str) -> str:
    strip = f"regexp_replace({x}, {lit('[' + T.SYMBOL_RANGES + ']+')}, '', 'g')"
    return f"regexp_replace({strip}, {lit(T.DASHES)}, ' ', 'g')"


def keyword_matches(x: str, stems: Sequence[str]) -> str:
    pat = lit(T.duck_ci(T.stems_body(stems)))
    return f"list_transform(regexp_extract_all({x}, {pat}, 1), lambda m: lower(m))"


def clean_for_topics(x: str) -> str:
    t = f"regexp_replace(coalesce({x}, ''), {lit(T.URL_BODY)}, ' ', 'g')"
    t = f"regexp_replace({t}, {lit(T.MENTION_TAG_BODY)}, ' ', 'g')"
    t = f"regexp_replace({t}, {lit('[^A-Za-z' + T.WS + ']')}, ' ', 'g')"
    t = f"lower({t})"
    t = f"regexp_replace({t}, {lit('[' + T.WS + ']+')}, ' ', 'g')"
    return f"trim({t})"


def analyzer_tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), {lit('[' + T.WORD + ']{2,}')}, 0)"


def r6(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 6)"


def screen_base(table: str, cols: str, order: str, key: str = "text") -> str:
    """Rows reaching the keyword stage: CTE body selecting ``cols`` + text."""
    return f"""
  b0 AS (SELECT {cols}, coalesce({key}, '') AS text FROM {table}),
  b1 AS (SELECT * FROM b0 WHERE NOT {is_url_only('text')}),
  b2 AS (SELECT * FROM b1 QUALIFY row_number() OVER (PARTITION BY text ORDER BY {order}) = 1),
  b3 AS (SELECT * FROM b2 WHERE {word_count('text')} >= 5),
  base AS (SELECT * REPLACE ({rewrite('text')} AS text) FROM b3)"""
