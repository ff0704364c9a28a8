"""Column expressions for text screening and cleaning.

Every pattern is written once as a body and given engine flags at the edge,
so Spark (Java regex) and the DuckDB oracle (RE2) read the same classes.
Classes are spelled out instead of ``\\w``/``\\s``/``\\b`` because those
shorthands mean different things in Python, Java and RE2; the classes below
follow Python 3's Unicode ``str`` semantics:

* ``WORD``  = letters, numbers and underscore (Python ``\\w``),
* ``WS``    = the characters for which ``str.isspace()`` is true.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python ``str.isspace`` as an explicit class body (works in Java and RE2).
WS = (r"\t\n\x{0B}\x{0C}\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
      r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
WORD = r"\p{L}\p{N}_"

# Code-point ranges removed by the symbol strip (fixed values of the
# published screening: six ranges, the last one very wide).
SYMBOL_RANGES = (r"\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}"
                 r"\x{1F1E0}-\x{1F1FF}\x{2702}-\x{27B0}\x{24C2}-\x{1F251}")

URL_ONLY_BODY = rf"^[{WS}]*(https?://[^{WS}]+|www\.[^{WS}]+)[{WS}]*$"
URL_BODY = rf"https?://[^{WS}]+|www\.[^{WS}]+"
MENTION_TAG_BODY = rf"(@[{WORD}]+)|(#[{WORD}]+)"
DASHES = "[-–—]"


def escape_literal(word: str) -> str:
    """Backslash every non-alphanumeric character (valid in Java and RE2)."""
    return "".join(ch if ch.isalnum() else "\\" + ch for ch in word)


def stems_body(stems: Sequence[str]) -> str:
    """Regex body whose group 1 is a word starting with one of ``stems``.

    The leading alternative stands in for a word boundary (a look-behind is
    not available in RE2); a match always ends at the end of a word, so the
    next match can consume the following non-word character.
    """
    if not stems:
        raise ValueError("empty stem list")
    alt = "|".join(escape_literal(s) for s in stems)
    return rf"(?:^|[^{WORD}])((?:{alt})[{WORD}]*)"


def spark_ci(body: str) -> str:
    """Case-insensitive with Unicode case folding, Java flavour."""
    return "(?iu)" + body


def duck_ci(body: str) -> str:
    return "(?i)" + body


# ------------------------------------------------------------------ expressions
def null_to_empty(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def is_url_only(c: Column) -> Column:
    return c.rlike(spark_ci(URL_ONLY_BODY))


def word_count(c: Column) -> Column:
    """Number of whitespace-separated words, as ``len(str.split())``."""
    return F.size(F.filter(F.split(c, f"[{WS}]+"), lambda w: w != "")).cast("long")


def has_min_words(c: Column, n: int) -> Column:
    """``len(str.split()) >= n`` without splitting: an anchored match of n
    words reads only the start of the text (the two classes are disjoint,
    so there is no backtracking blow-up). The oracle counts by splitting."""
    if n <= 0:
        return F.lit(True)
    word, sp = f"[^{WS}]+", f"[{WS}]+"
    return c.rlike(f"^[{WS}]*(?:{word}{sp}){{{n - 1}}}{word}")


def strip_symbols(c: Column) -> Column:
    return F.regexp_replace(c, f"[{SYMBOL_RANGES}]+", "")


def dashes_to_space(c: Column) -> Column:
    return F.regexp_replace(c, DASHES, " ")


def keyword_matches(c: Column, stems: Sequence[str]) -> Column:
    """All stem-initial words in text order, lower-cased, duplicates kept."""
    pat = spark_ci(stems_body(stems))
    return F.transform(F.regexp_extract_all(c, F.lit(pat), 1), lambda m: F.lower(m))


def clean_for_topics(c: Column) -> Column:
    """URL -> space; @mention/#tag -> space; non-ASCII-letter -> space;
    lower; collapse white space; trim.

    The last four steps are one replacement here: every character that is
    not an ASCII letter ends up as a space and runs of spaces collapse, so
    each maximal run of non-letters becomes one space. Lower-casing after
    that touches ASCII only (the fast path). The oracle SQL spells out the
    four steps separately, which checks the equivalence.
    """
    t = F.regexp_replace(null_to_empty(c), URL_BODY, " ")
    t = F.regexp_replace(t, MENTION_TAG_BODY, " ")
    return F.trim(F.lower(F.regexp_replace(t, "[^A-Za-z]+", " ")))


def analyzer_tokens(c: Column) -> Column:
    """Lower-cased tokens of two or more word characters."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"[{WORD}]{{2,}}"), 0)


def python_split_words(text: str) -> list[str]:
    """Reference implementation used by tests (plain Python semantics)."""
    return text.split()


_PY_KEYWORD_CACHE: dict[tuple[str, ...], re.Pattern] = {}


def python_keyword_matches(text: str, stems: Sequence[str]) -> list[str]:
    """Plain-Python form of :func:`keyword_matches` for brute-force tests."""
    key = tuple(stems)
    rx = _PY_KEYWORD_CACHE.get(key)
    if rx is None:
        rx = re.compile(r"\b(?:%s)\w*\b" % "|".join(map(re.escape, stems)), re.IGNORECASE)
        _PY_KEYWORD_CACHE[key] = rx
    return [m.lower() for m in rx.findall(text)]
