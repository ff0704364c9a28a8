import random

from textrisk.llm.mixing import fill, min_cost_flow, mix, mixed_documents, route, water_fill


def test_water_fill_shares_by_weight_and_stops_at_the_cap():
    assert water_fill([100, 100, 100], [1, 2, 3], 3) == [50.0, 100.0, 150.0]
    got = water_fill([1000, 10, 10], [1, 2, 3], 3)
    assert got[1:] == [30.0, 30.0] and abs(sum(got) - 1020) < 1e-9
    assert water_fill([], [], 3) == [] and water_fill([0, 5], [1, 2], 3) == [0.0, 5.0]


def test_flow_prefers_first_readings():
    # Sources A and B overlap in one pattern: first readings of all patterns go before second ones.
    patterns = [(("A",), 10), (("A", "B"), 10), (("B",), 10)]
    assert route(patterns, {"A": 15, "B": 15}, 3) == [10, 10, 10]
    assert sum(route(patterns, {"A": 30, "B": 20}, 3)) == 50
    assert max(route(patterns, {"A": 30, "B": 20}, 3)) <= 20


def test_flow_on_a_small_graph():
    edges = [[0, 1, 3, 1], [0, 2, 3, 5], [1, 3, 2, 0], [2, 3, 4, 0], [1, 2, 9, 1]]
    assert min_cost_flow(4, edges, 0, 3) == [3, 3, 2, 4, 1]


def test_fill_reaches_the_nearest_sum():
    rnd = random.Random(2)
    for _ in range(50):
        sizes = [rnd.randint(0, 40) for _ in range(12)]
        left = rnd.randint(0, sum(sizes))
        sums = {0}
        for s in sizes:
            sums |= {x + s for x in sums}
        assert sum(s for s, t in zip(sizes, fill(sizes, left), strict=True) if t) == max(x for x in sums if x <= left)
    assert sum(fill([3] * 1000, 2000)) == 666


def rows():
    rnd = random.Random(1)
    out = [(i, " ".join("w" * 3 for _ in range(rnd.randint(1, 50))), "en", rnd.choice(["a", "a", "a", "b", "c", None]))
           for i in range(300)]
    return out + [(900, None, "en", "a"), (901, "", "en", "b"), (902, "one\ttwo\nthree", "en", "c"),
                  (902, "one\ttwo\nthree", "en", "c"), (None, "null id", None, None)]


def test_mix_meets_targets_and_reruns_agree(docs_of):
    docs = docs_of(rows())
    first = mix(docs).toPandas()
    assert len(first) == docs.count()
    assert (first["taken"] <= 3 * first["size"]).all()
    for _, g in first.groupby(["source_size", "target"]):  # two sources may share a target
        assert abs(g["taken"].sum() - g["target"].iloc[0]) < 3
        assert g["source_size"].iloc[0] == g["size"].sum()
    order = ["_mx_id", "_mx_hash", "size", "taken"]
    again = mix(docs.repartition(4)).toPandas()
    assert first[order].fillna(-1).sort_values(order).values.tolist() == again[order].fillna(-1).sort_values(order).values.tolist()
    assert abs(first["taken"].sum() - first["size"].sum()) < 8


def test_overlapping_sources(spark):
    docs = spark.createDataFrame([(i, "w " * 10, ["a"] if i % 2 else ["a", "b"]) for i in range(40)],
                                 "doc_id long, text string, source array<string>")
    got = mix(docs).toPandas()
    assert got["taken"].sum() <= 3 * got["size"].sum() and got["taken"].sum() > 0


def test_mixed_documents_repeat_rows(docs_of):
    docs = docs_of([(i, "w " * 10, "en", "a" if i < 80 else "b") for i in range(100)])
    got = mixed_documents(docs)
    assert got.columns == docs.columns
    assert got.where("source = 'b'").count() == 60  # target 3 times its size
    assert got.where("source = 'a'").count() == 40


def test_empty_table(docs_of):
    assert mix(docs_of([])).count() == 0
    assert mixed_documents(docs_of([])).count() == 0
