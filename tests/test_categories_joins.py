"""Category roll-up golden values and join checks."""

import pytest

from textrisk.operators import categories as G
from textrisk.operators import joins as H

# (Topic, Label_A, Label_B, Gold_label, Count) of the published topic table.
TOPICS = [(0, 4, 4, 4, 1009), (1, 5, 5, 5, 674), (2, 1, 1, 1, 569), (3, 5, 5, 5, 507), (4, 2, 2, 2, 474),
          (5, 3, 3, 3, 408), (6, 3, 3, 3, 384), (7, 1, 5, 5, 295), (8, 5, 5, 5, 294), (9, 4, 4, 4, 288),
          (10, 1, 5, 5, 283), (11, 1, 1, 1, 270), (12, 1, 4, 1, 257), (13, 1, 1, 1, 244), (14, 1, 1, 1, 240),
          (15, 5, 5, 5, 232), (16, 3, 3, 3, 232), (17, 5, 5, 5, 210), (18, 3, 3, 3, 190), (19, 3, 3, 3, 186),
          (20, 1, 1, 1, 180), (21, 5, 5, 5, 164), (22, 5, 5, 5, 149), (23, 3, 3, 3, 135), (24, 4, 4, 4, 134),
          (25, 1, 4, 4, 133), (26, 2, 2, 2, 133), (27, 3, 3, 3, 132), (28, 5, 5, 5, 120), (29, 5, 5, 5, 116),
          (30, 1, 1, 1, 108), (31, 4, 5, 5, 94), (32, 5, 1, 5, 94)]


@pytest.fixture()
def mapping(spark):
    return spark.createDataFrame(TOPICS, "topic int, label_a int, label_b int, category int, n_docs long")


def test_rollup(mapping):
    got = {r.category: (r.n_topics, r.n_documents, round(r.share_pct, 2), r.category_name)
           for r in G.category_rollup(mapping).collect()}
    assert sum(v[1] for v in got.values()) == 8938
    assert got[1][:3] == (7, 1868, 20.90) and got[1][3] == "Technical safety"
    assert got[2][:3] == (2, 607, 6.79)
    assert got[3][:3] == (7, 1667, 18.65)
    assert got[4][:3] == (4, 1564, 17.50)
    assert got[5][:3] == (13, 3232, 36.16)


def test_top_topics(mapping):
    got = {}
    for r in G.top_topics_per_category(mapping, 3).orderBy("category", "rank").collect():
        got.setdefault(r.category, []).append(r.topic)
    assert got == {1: [2, 11, 12], 2: [4, 26], 3: [5, 6, 16], 4: [0, 9, 24], 5: [1, 3, 7]}


def test_coder_kappa_and_disagreements(mapping):
    assert G.coder_agreement(mapping).collect()[0].kappa == pytest.approx(0.760290557, abs=1e-9)
    assert sorted(r.topic for r in G.coder_disagreements(mapping).collect()) == [7, 10, 12, 25, 31, 32]


def test_violations_report_unmapped(spark, mapping):
    docs = spark.createDataFrame([(1, 0), (2, 40), (3, -1)], "id long, topic int")
    got = [(r.topic, r.problem) for r in G.category_violations(docs, mapping).collect()]
    assert got == [(40, "unmapped")]
    dup = mapping.unionByName(spark.createDataFrame([(0, 1, 1, 1, 5)], mapping.schema))
    assert [(r.topic, r.problem) for r in G.category_violations(docs, dup).collect()] == \
        [(0, "multiple_categories"), (40, "unmapped")]


def test_coverage_audit(spark):
    sample = spark.createDataFrame([(i, 1 if i < 6 else 0) for i in range(100)], "id long, risk_label int")
    r = G.coverage_audit(sample, "risk_label").collect()[0]
    assert (r.positives, r.n) == (6, 100)
    assert r.ci_low == pytest.approx(0.027786124, abs=1e-9) and r.ci_high == pytest.approx(0.124768154, abs=1e-9)


def test_rehydrate_duplicate_key_fails(spark):
    ids = spark.createDataFrame([(1,), (2,)], "id long")
    src = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "id long, content string")
    with pytest.raises(ValueError):
        H.rehydrate(ids, src, "id", ["content"])


def test_rehydrate_and_unmatched(spark):
    ids = spark.createDataFrame([(1,), (3,)], "id long")
    src = spark.createDataFrame([(1, "a"), (2, "c")], "id long, content string")
    got = {r.id: r.content for r in H.rehydrate(ids, src, "id", ["content"]).collect()}
    assert got == {1: "a", 3: None}
    assert [r.id for r in H.unmatched(ids, src, "id").collect()] == [3]
