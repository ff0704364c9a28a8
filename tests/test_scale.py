"""Plans and dealing that keep time and memory of a task in bounds as tables grow."""

import random

import pytest
from pyspark.sql import functions as F

from textrisk import session
from textrisk.operators import baselines as B
from textrisk.operators import coherence as CO
from textrisk.operators import density as D
from textrisk.operators import spectral as S
from textrisk.operators import sweeps as SW
from textrisk.operators import textprep as P
from textrisk.operators import topics as TP


def plan_of(df, capsys):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def test_parts_follow_the_size_of_the_files(spark, tmp_path, monkeypatch):
    df = spark.range(50_000).select(F.rand(1).alias("x"))
    df.coalesce(2).write.parquet(str(tmp_path / "t"))
    held = sum(f.stat().st_size for f in (tmp_path / "t").iterdir() if not f.name.startswith("."))
    monkeypatch.setattr(session, "PART_BYTES", held // 20)
    assert 20 <= session.parts_of(spark.read.parquet(str(tmp_path / "t"))) <= 22
    assert session.parts_of(df) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_blank_rows_go_after_the_write(spark, capsys):
    """Without the last filter nothing of the token work moves into the scan."""
    df = spark.createDataFrame([(1, "Models the 1"), (2, "the"), (3, "models THE"), (4, None)], "doc_id long, text string")
    kept = P.drop_empty(session.materialize(P.finalized_texts(df, "text", "doc_id")))
    want = P.prepare_topic_text(df, "text", "doc_id")
    assert [(r.doc_id, r.finalized) for r in kept.collect()] == [(r.doc_id, r.finalized) for r in want.collect()] == [(1, "model")]
    assert "filter(" not in plan_of(kept, capsys)


def test_positions_serve_every_width(spark):
    rnd = random.Random(4)
    texts = [[rnd.choice("abcdef") for _ in range(rnd.randrange(0, 30))] for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, terms array<string>")
    tw = spark.createDataFrame([(0, "a"), (0, "b"), (1, "c"), (1, "d"), (1, "z")], "topic int, term string")
    held = CO.WordPositions(df, tw)
    for w in (3, 10):
        occ, co, total = CO.window_counts(None, tw, w, positions=held)  # the texts are not read again
        want_occ, want_co, n = CO.brute_force_counts(texts, w)
        assert total.first()["N"] == n
        assert {r.word: r.occ for r in occ.collect()} == {x: want_occ[x] for x in "abcd"}
        got = {(r.w1, r.w2): r.co for r in co.collect()}
        assert got[("a", "b")] == want_co.get(("a", "b"), 0) and got[("c", "d")] == want_co.get(("c", "d"), 0)
        assert got[("c", "z")] == 0


def test_near_points_are_summed_from_arrays(spark, capsys):
    rnd = random.Random(5)
    rows = [(i, [rnd.random() for _ in range(3)], 1) for i in range(300)]
    blocks = D.in_blocks(spark.createDataFrame(rows, "id long, x array<double>, weight long"), block=64, trees=4)
    near = D.near_points(blocks, 5)
    assert "collect_set" not in plan_of(near, capsys)
    at = {i: x for i, x, _ in rows}
    for r in near.collect():
        assert len(r.near) == len({e.j for e in r.near}) == 5 and r.id not in {e.j for e in r.near}
        assert [e.d for e in r.near] == sorted(e.d for e in r.near)
        for e in r.near:
            assert e.d == pytest.approx(sum((a - b) ** 2 for a, b in zip(at[r.id], at[e.j], strict=True)) ** 0.5)


def test_the_fuzzy_graph_is_written_once(spark, capsys):
    near = spark.createDataFrame([(1, [(0.5, 2)]), (2, [(0.5, 1)])], "id long, near array<struct<d: double, j: long>>")
    assert "Python" not in plan_of(S.fuzzy_graph(near), capsys)


def test_no_task_sorts_the_vocabulary(spark, capsys):
    df = spark.createDataFrame([(i % 3, ["a", "b", f"w{i % 5}", "a"]) for i in range(12)], "fold int, terms array<string>")
    got = B.fold_vocabularies(df, 3, max_features=4)
    assert "TakeOrderedAndProject" in plan_of(got, capsys)
    for fold in range(3):
        want = B.tfidf_vocabulary(df.where(F.col("fold") != fold).withColumn("doc_id", F.lit(1)), "doc_id", "terms", 4)
        rows = got.where(F.col("fold") == fold).select("term", "n_docs", "n_total", "idf").collect()
        assert sorted(rows) == sorted(want.select("term", "n_docs", "n_total", "idf").collect())


def test_terms_are_dealt_by_their_size(spark, monkeypatch):
    """The sort of a task is a part of the written counts, whatever the shuffle partitions."""
    counts = session.materialize(spark.range(2000).select(
        (F.col("id") % 3).cast("int").alias("topic"), F.concat(F.lit("w"), F.col("id") % 700).alias("term"), F.lit(2).cast("long").alias("count")))
    monkeypatch.setattr(session, "PART_BYTES", 500)
    parts = session.parts_of(counts)
    assert parts > 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert TP.class_tfidf(counts).rdd.getNumPartitions() == parts
    assert SW.setting_weights(counts.withColumn("setting", F.col("count").cast("int"))).rdd.getNumPartitions() == parts


def test_cells_of_equal_topics_are_counted_exactly(spark):
    prep = spark.createDataFrame([(1, "red fox"), (2, "red dog"), (3, ""), (4, "red fox")], "doc_id long, finalized string")
    asg = spark.createDataFrame([(s, d, t) for s, d, t in [(1, 1, 0), (1, 2, 0), (1, 3, 0), (1, 4, 1), (2, 1, 5), (2, 2, 6), (2, 3, 5), (2, 4, 5)]],
                                "setting int, doc_id long, topic int")
    got = {(r.setting, r.topic, r.term): r["count"] for r in SW.setting_term_counts(prep, asg).collect()}
    assert got == {(1, 0, "red"): 2, (1, 0, "fox"): 1, (1, 0, "dog"): 1, (1, 0, "red fox"): 1, (1, 0, "red dog"): 1, (1, 0, "fox red"): 1,
                   (1, 1, "red"): 1, (1, 1, "fox"): 1, (1, 1, "red fox"): 1,
                   (2, 5, "red"): 2, (2, 5, "fox"): 2, (2, 5, "red fox"): 2, (2, 5, "fox red"): 1,
                   (2, 6, "red"): 1, (2, 6, "dog"): 1, (2, 6, "red dog"): 1}


def test_term_sums_need_no_shuffle(spark, capsys):
    """Counts carry the sum of their term, written in one place: weights need no exchange by term, and are the same."""
    prep = spark.createDataFrame([(1, 0, "red fox"), (2, 0, "red dog"), (3, 1, "fox den"), (4, None, "red den"), (5, -1, "")],
                                 "doc_id long, topic int, finalized string")
    counts = TP.class_term_counts(prep, "topic", "doc_id", "finalized", stopwords=[])
    assert "hashpartitioning(term" not in plan_of(TP.class_tfidf(counts), capsys)
    want = {(r.topic, r.term): r.weight for r in TP.class_tfidf(counts.drop("_f")).collect()}
    assert {(r.topic, r.term): r.weight for r in TP.class_tfidf(counts).collect()} == want
    asg = prep.select(F.explode(F.array(F.lit(7), F.lit(8))).alias("setting"), "doc_id",
                      F.coalesce("topic", F.lit(2)).alias("topic")).where("setting = 7 or doc_id < 4")
    counts = SW.setting_term_counts(prep, asg)
    assert "term" not in "".join(x for x in plan_of(SW.setting_weights(counts), capsys).splitlines() if "Exchange hash" in x)
    want = {tuple(r)[:3]: r.weight for r in SW.setting_weights(counts.drop("_f")).collect()}
    assert {tuple(r)[:3]: r.weight for r in SW.setting_weights(counts).collect()} == want


def test_prepared_texts_are_written_once(spark):
    """The files hold the tokens; the finalized text comes from them."""
    from textrisk.plans.topics import prepared
    prep = prepared(spark, "/root/testdata/sf0.001")
    assert spark.read.parquet(*prep.inputFiles()).columns == ["doc_id", "topic", "tokens"]
    assert prep.where("finalized <> array_join(tokens, ' ') or trim(finalized) = ''").isEmpty()
