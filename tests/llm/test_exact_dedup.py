import hashlib

from pyspark.sql import functions as F

from textrisk.llm.exact_dedup import dedup_classes, exact_dedup

ROWS = [(1, "Abc def"), (2, "aBC DEF"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, "x" * 30_000), (8, "X" * 30_000),
        (2, "aBC DEF"), (None, "abc def"), (None, "solo"), (9, " abc def")]


def brute(rows):
    def norm(t):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        left = True
        for i in sorted(ids, key=lambda i: (i is None, i)):
            out.append((i, keep, len(ids), i == keep and left, hashlib.sha256(t.encode()).digest()))
            left = left and i != keep
    return sorted(out, key=repr)


def result(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.digest)) for r in df.collect()), key=repr)


def test_classes_match_brute_force(docs_of):
    assert result(dedup_classes(docs_of(ROWS).repartition(5))) == brute(ROWS)


def test_texts_that_share_a_digest_do_not_merge(docs_of):
    weak = dedup_classes(docs_of(ROWS).repartition(3), digest=lambda c: F.lit(b"same"))
    assert [r[:4] for r in result(weak)] == sorted((r[:4] for r in brute(ROWS)), key=repr)


def test_one_hot_text(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "Same").otherwise(
        F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text")).repartition(16)
    got = dedup_classes(docs)
    assert got.where("kept").count() == 4001
    assert got.where("group_size = 2000 and keep_id = 5997").count() == 2000


def test_survivors_keep_their_columns(docs_of):
    docs = docs_of(ROWS)
    got = exact_dedup(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in got.collect()) == [-1, 2, 4, 5, 6, 8, 9]


def test_empty_table(docs_of):
    assert dedup_classes(docs_of([])).count() == 0
    assert exact_dedup(docs_of([])).count() == 0


def test_texts_move_once_after_the_classes(spark, tmp_path):
    """One shuffle of whole rows serves the join and the choice among repeated ones."""
    rows = [(1, "a"), (1, "a"), (None, "b"), (None, "B"), (2, None), (3, "A")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "docs"))
    kept = exact_dedup(spark.read.parquet(str(tmp_path / "docs")))
    assert sorted((r.doc_id or 0, (r.text or "").lower()) for r in kept.collect()) == [(0, "b"), (2, ""), (3, "a")]
    broad = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        import contextlib
        import io
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            exact_dedup(spark.read.parquet(str(tmp_path / "docs"))).explain()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broad)
    # Outer plan: the aggregation of the repeated rows stands on the join without an exchange between.
    top = out.getvalue().split("SortMergeJoin")[0]
    assert "Exchange" not in top
