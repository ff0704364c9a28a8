"""Screening stages on inline rows (the features the driver tables lack)."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textrisk.functions import text as T
from textrisk.lexicons import KEYWORD_STEMS, TEST_LEXICON
from textrisk.operators import screen as S


def _df(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")


def _col(df, c):
    return [r[c] for r in df.orderBy("id").collect()]


def test_url_only_dropped(spark):
    df = _df(spark, ["  HTTPS://t.co/x ", "www.a.b", "https://t.co/x hi", "see www.a.b now"])
    assert _col(S.drop_url_only(df, "text"), "id") == [2, 3]


def test_null_text_becomes_empty_and_fails_word_rule(spark):
    df = _df(spark, [None, "one two three four five"])
    out = S.min_words(S.prepare(df, "text"), "text")
    assert _col(out, "id") == [1]
    assert _col(S.prepare(df, "text"), "text")[0] == ""


def test_dedup_keeps_first_in_file_order(spark):
    df = _df(spark, ["Same text here", "Same text here", "same text here"])
    assert _col(S.dedup_first(df, ["text"], "id"), "id") == [0, 2]


def test_emoji_difference_survives_dedup_then_strip(spark):
    df = _df(spark, ["a b c d e", "a b c d e \U0001F600"])
    out = S.rewrite_text(S.dedup_first(S.min_words(df, "text"), ["text"], "id"), "text")
    assert _col(out, "text") == ["a b c d e", "a b c d e "]


def test_emoji_counts_as_word_before_strip(spark):
    df = _df(spark, ["a b c d \U0001F600"])
    out = S.rewrite_text(S.min_words(df, "text"), "text")
    assert _col(out, "text") == ["a b c d "]


def test_symbol_ranges(spark):
    df = _df(spark, ["a漢b", "a\U0001F916b", "aアb", "a✂b"])
    out = df.select("id", T.strip_symbols(F.col("text")).alias("s"))
    assert _col(out, "s") == ["ab", "a\U0001F916b", "ab", "ab"]


def test_word_count_python_split(spark):
    texts = ["", "  a b ", "a b", "a\tb\nc", "x　y z"]
    out = _df(spark, texts).select("id", T.word_count(F.col("text")).alias("n"))
    assert _col(out, "n") == [len(t.split()) for t in texts]


def test_dash_then_match(spark):
    df = S.rewrite_text(_df(spark, ["high-risk high–risk high—risk"]), "text")
    out = S.with_keyword_matches(df, "text", ["risk"])
    assert _col(out, "text") == ["high risk high risk high risk"]
    assert _col(out, "matched_keywords") == [["risk", "risk", "risk"]]


def test_matches_order_duplicates_case(spark):
    out = S.with_keyword_matches(_df(spark, ["Risk of RESPONSIBILITY risk"]), "text", KEYWORD_STEMS)
    assert _col(out, "matched_keywords") == [["risk", "responsibility", "risk"]]


def test_stem_inside_word_no_match(spark):
    out = S.with_keyword_matches(_df(spark, ["biohazard asterisk"]), "text", KEYWORD_STEMS)
    assert _col(out, "matched_keywords") == [[]]


def test_unicode_word_characters(spark):
    out = S.with_keyword_matches(_df(spark, ["sécurité ésecure securés"]), "text", ["secur"])
    assert _col(out, "matched_keywords") == [["securés"]]


def test_bad_date_is_null_row_kept(spark):
    df = spark.createDataFrame([(1, "junk"), (2, "2023-01-11 10:00:00+00:00")], "id long, date string")
    out = df.select("id", S.coerce_date("date").alias("d")).orderBy("id").collect()
    assert out[0]["d"] is None and str(out[1]["d"]) == "2023-01-11"


def test_screen_end_to_end_and_funnel(spark):
    texts = ["https://t.co/x", "You are a stupid clown, truly", "You are a stupid clown, truly",
             "too short", "nothing to see in this sentence", "What a pathetic-ish move here ok"]
    df = _df(spark, texts)
    cands = S.screen(df, "text", "id", TEST_LEXICON)
    assert _col(cands, "id") == [1, 5]
    assert _col(cands, "matched_keywords") == [["stupid", "clown"], ["pathetic"]]
    funnel = {r["stage"]: (r["removed"], r["remaining"]) for r in S.screen_funnel(df, "text", TEST_LEXICON).collect()}
    assert funnel["url_only_removed"] == (1, 5)
    assert funnel["duplicates_removed"] == (1, 4)
    assert funnel["short_removed"] == (1, 3)
    assert funnel["keyword_filtered"] == (1, 2)


def test_sample_is_repeatable(spark):
    df = spark.range(200).withColumnRenamed("id", "doc_id")
    a = [r.doc_id for r in S.sample_for_audit(df, "doc_id", 10, 7).collect()]
    b = [r.doc_id for r in S.sample_for_audit(df, "doc_id", 10, 7).collect()]
    assert a == b and len(set(a)) == 10


_ALPHABET = list("abcdefghijklmnopqrstuvwxyzRISK_-éß漢 \t\n.,!'0123456789")


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet=_ALPHABET, max_size=60), min_size=1, max_size=8))
def test_keyword_matches_equal_python_regex(spark, texts):
    stems = ["risk", "saf", "ab", "é"]
    df = _df(spark, texts)
    got = _col(S.with_keyword_matches(df, "text", stems), "matched_keywords")
    assert got == [T.python_keyword_matches(t, stems) for t in texts]


def test_random_word_counts_equal_python():
    rnd = random.Random(1)
    for _ in range(50):
        s = "".join(rnd.choice(" \t ab\n") for _ in range(rnd.randint(0, 12)))
        assert T.python_split_words(s) == s.split()


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet=list("ab \t\n 　x"), max_size=30), min_size=1, max_size=6),
       st.integers(0, 6))
def test_has_min_words_equals_split(spark, texts, n):
    df = _df(spark, texts)
    got = _col(df.select("id", T.has_min_words(F.col("text"), n).alias("ok")), "ok")
    assert got == [len(t.split()) >= n for t in texts]
