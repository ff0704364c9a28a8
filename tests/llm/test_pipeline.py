import corpus_pipeline
import __spark_entry__
import pytest

from textrisk.llm.common import table
from textrisk.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_every_operator_has_one_query():
    names = __spark_entry__.queries()
    assert all(sum(q.startswith(f"op{n}_") for q in names) == 1 for n in range(1, 14)) and "pipeline" in names
    assert set(QUERIES) <= set(names) and set(__spark_entry__.oracle_sql()) <= set(names)


def test_stages_keep_the_columns_and_run_to_the_end(spark):
    docs = table(spark, SF, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns, docs = docs.columns, stage(spark, docs, SF).cache()
        assert docs.columns == columns
        kept[name] = [r.doc_id for r in docs.collect()]
    assert len(kept["language_id"]) >= len(kept["exact_dedup"]) >= len(kept["ngram_jaccard_join"])
    text = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    lower = [text[d].lower() for d in kept["exact_dedup"]]
    assert len(set(lower)) == len(lower) == len({t.lower() for t in text.values()})
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas()
    assert set(packed["doc_id"]) == set(kept["mix_sources"])
    assert packed.groupby("sequence_id")["length"].sum().max() <= 4096
    docs.unpersist()


def test_odd_rows_pass_every_stage(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "hello there", "en", "a", 11), (3, "hello there", "en", "a", 11),
            (4, "1 2 3", "de", None, 5), (None, "some words", None, "b", 10), (5, "x" * 100_000, "en", "b", 100_000)]
    docs = spark.createDataFrame(rows, table(spark, SF, "documents").schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= 0


@pytest.mark.parametrize("k", range(5))
def test_empty_documents(spark, k):
    empty = table(spark, SF, "documents").limit(0)
    assert corpus_pipeline.STAGES[k][1](spark, empty, SF).count() == 0


def small_corpus():
    from test_jaccard_join import corpus
    texts = corpus(4) + [(900, "1 2 3 ... 4"), (901, ""), (902, None), (903, "é"), (904, "Ω 7"), (905, "_ _"), (906, "123 four")]
    return [(d, t, "en" if d % 2 else "de", "ab"[d % 2], len(t or "")) for d, t in texts]


@pytest.mark.parametrize("labels", ["all", "none", "held out only"])
def test_language_stage_keeps_every_text_with_a_letter(spark, labels):
    from textrisk.llm.langid import held_out
    schema = table(spark, SF, "documents").schema
    docs = spark.createDataFrame(small_corpus(), schema)
    if labels == "none":
        docs = docs.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang", "source", "n_chars")
    elif labels == "held out only":
        from pyspark.sql import functions as F
        docs = docs.withColumn("lang", F.when(held_out(), F.col("lang")))
    got = sorted(r.doc_id for r in corpus_pipeline.language_id(spark, docs, SF).collect())
    assert got == sorted(d for d, t, *_ in small_corpus() if any(c.isalpha() for c in t or ""))


def test_near_copies_match_brute_force(spark):
    from test_jaccard_join import brute
    rows = [r for r in small_corpus() if r[1]]
    docs = spark.createDataFrame(rows, table(spark, SF, "documents").schema)
    want = sorted(d for d, _, least in brute([r[:2] for r in rows]) if d == least)
    assert sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, docs, SF).collect()) == want and len(want) < len(rows)
