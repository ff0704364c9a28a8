import hashlib
import random
import re

from pyspark.sql import functions as F

from textrisk.llm.fingerprints import (K, containment, distinct_shingles, edited_pairs, merge, op5_document_fingerprints,
                                       resemblance, smallest, with_sketch)


def shingle_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_edited_texts_and_short_likeness(docs_of):
    rnd = random.Random(6)
    rows = [(i * 3, " ".join(rnd.choice(["aa", "Bb", "cé", "d\n"]) for _ in range(rnd.randint(0, 40)))) for i in range(60)]
    rows += [(500, None), (501, ""), (502, "one")]
    got = {r.doc_id: r for r in edited_pairs(docs_of(rows).repartition(4)).select(
        "doc_id", "edited", resemblance(F.col("sketch"), F.col("next_sketch")).alias("j")).collect()}
    order = sorted(rows, reverse=True)
    for i, (d, t) in enumerate(order):
        t, after = t or "", order[(i + 1) % len(order)][1] or ""
        cut = len(t) // 3
        assert got[d].edited == t[:len(t) - cut] + after[:cut]
        assert abs(got[d].j - jaccard(shingle_set(t), shingle_set(after))) < 1e-12


def test_repeated_null_and_single_rows(docs_of):
    rows = [(1, "a b c"), (1, "a b c"), (1, "d e f"), (None, "g h i"), (2, "x" * 60_000)]
    got = edited_pairs(docs_of(rows)).collect()
    assert len(got) == 5
    assert len({r.edited for r in got if r.text == "a b c"}) == 1
    single = edited_pairs(docs_of([(7, "abcdef")])).collect()
    assert [r.edited for r in single] == ["abcdab"]
    assert edited_pairs(docs_of([])).count() == 0


def test_estimates_on_long_texts(spark):
    rnd = random.Random(8)
    a = [f"w{rnd.randrange(5000)}" for _ in range(3000)]
    b = a[:2000] + [f"v{rnd.randrange(5000)}" for _ in range(1000)]
    df = spark.createDataFrame([(" ".join(a), " ".join(b))], "a string, b string")
    df = with_sketch(with_sketch(df, F.col("a"), "sa"), F.col("b"), "sb")
    r = df.select(resemblance(F.col("sa"), F.col("sb")).alias("j"), containment(F.col("sa"), F.col("sb")).alias("c"),
                  distinct_shingles(F.col("sa")).alias("n"), F.size("sa").alias("k")).first()
    sa, sb = shingle_set(" ".join(a)), shingle_set(" ".join(b))
    assert r.k == K and abs(r.j - jaccard(sa, sb)) < 0.13
    assert abs(r.c - len(sa & sb) / len(sa)) < 0.2 and abs(r.n / len(sa) - 1) < 0.3


def test_merge_of_parts_is_the_sketch_of_the_union(spark):
    df = spark.range(1).select(F.sequence(F.lit(1), F.lit(1000)).alias("x")).select(
        F.transform("x", lambda v: F.xxhash64(v)).alias("all"))
    df = df.withColumn("l", smallest(F.slice("all", 1, 600))).withColumn("r", smallest(F.slice("all", 500, 501)))
    assert df.where(merge(F.col("l"), F.col("r")) == smallest(F.col("all"))).count() == 1


def test_equal_texts_have_equal_fingerprints(spark):
    got = op5_document_fingerprints(spark, "/root/testdata/sf0.001").toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").toPandas()
    both = got.merge(docs, on="doc_id")
    assert (both.groupby("text")["fingerprint"].nunique() == 1).all()
    order = docs.sort_values("doc_id", ascending=False)["text"].tolist()
    for i, d in enumerate(docs.sort_values("doc_id", ascending=False)["doc_id"]):
        cut = len(order[i]) // 3
        edited = order[i][:len(order[i]) - cut] + order[(i + 1) % len(order)][:cut]
        row = both[both["doc_id"] == d].iloc[0]
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(row["near_edited"] - jaccard(shingle_set(order[i]), shingle_set(edited))) < 0.2
