"""Merkle manifest against a plain recursive build."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from textrisk.llm import merkle as M


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    parts = []
    for v in row:
        s = None if v is None else str(v)
        parts.append("-" if s is None else f"{len(s.encode())}:{s}")
    return h(*parts)


def climb(nodes, fanout=8):
    """(root, path per node) of one tree over (digest, ...) in order."""
    paths, places, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for k, p in enumerate(places):
            a = p // fanout * fanout
            paths[k].append(("".join(level[a:p]), "".join(level[p + 1:a + fanout])))
        level = [h(*level[a:a + fanout]) for a in range(0, len(level), fanout)]
        places = [p // fanout for p in places]
    return level[0], paths


def brute(rows, fanout=8):
    """rows (doc_id, source, lang, n_chars, text) -> sorted result tuples of the query."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subs, inner = [], []
    for g in order:
        own = sorted(((r[0] is not None, r[0], leaf_of(r), r) for r in groups[g]), key=lambda x: (x[0], x[1] or 0, x[2]))
        sub, paths = climb([o[2] for o in own], fanout)
        subs.append(sub)
        inner.append([(o[3], o[2], p) for o, p in zip(own, paths, strict=True)])
    root, tops = climb(subs, fanout) if subs else (None, [])
    out = []
    for sub, members, top in zip(subs, inner, tops, strict=True):
        for r, leaf, path in members:
            acc = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                low = None if r[4] is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4])
                acc = leaf_of((*r[:4], low))
            for left, right in path + top:
                acc = h(left, acc, right)
            out.append((r[0], leaf, sub, root, h(*[x + y for x, y in path + top]), acc, acc == root))
    return sorted(out, key=repr)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, digest string, level int, path string"


def run(spark, rows, tmp_path, name="documents"):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    df.write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
    return sorted((tuple(r) for r in M.op13_merkle_manifest(spark, str(tmp_path)).collect()), key=repr)


def test_matches_plain_build_over_several_levels(spark, tmp_path):
    rows = [(i, f"s{i % 3}", None if i % 50 == 0 else f"l{i % 2 + (i % 97 == 0) * (2 + i % 9)}", i, f"Text {i} É")
            for i in range(1, 700)]
    rows.append((1000, None, "alone", None, None))
    assert run(spark, rows, tmp_path) == brute(rows)


def test_one_group_and_one_row(spark, tmp_path):
    rows = [(i, "s", "en", 1, "a" * i) for i in range(65)]
    assert run(spark, rows, tmp_path / "a") == brute(rows)
    one = [(3, "s", "en", 1, "Only")]
    assert run(spark, one, tmp_path / "b") == brute(one)


def test_odd_rows(spark, tmp_path):
    """Nulls in every column, repeated rows and ids, empty and long texts, special digits."""
    rows = [(None, None, None, None, None), (None, None, None, None, None), (5, "a", "", 0, ""), (5, "a", "", 0, ""),
            (5, "a", "", 0, "B"), (7, "ü:1-", "top", -3, "A" * 300_000), (8, "s", "g", 1, "-"), (9, "s", "日本", 1, "x\0y")]
    assert run(spark, rows, tmp_path) == brute(rows)


def test_empty_table(spark, tmp_path):
    assert run(spark, [], tmp_path) == []


@pytest.mark.parametrize("fanout", [2])
def test_deep_paths_need_several_doublings(spark, fanout):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), (F.col("id") % 5 == 0).cast("string").alias("lang"))
    proofs, root = M.merkle_manifest(docs, M.digest(F.col("doc_id").cast("string")), fanout=fanout)
    got = {r["id"]: r for r in proofs.withColumn("folded", M.fold(F.col("leaf"), F.col("path"))).collect()}
    groups = [[i for i in range(200) if (i % 5 == 0) == g] for g in (False, True)]
    trees = [climb([h(str(i)) for i in g], fanout) for g in groups]
    top, above = climb([t[0] for t in trees], fanout)
    assert root == top and len(got) == 200
    for g, (sub, paths), up in zip(groups, trees, above, strict=True):
        for i, path in zip(g, paths, strict=True):
            assert got[i]["folded"] == root and got[i]["subroot"] == sub
            assert [(s["left"], s["right"]) for s in got[i]["path"]] == path + up


def test_driver_table_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    df = M.op13_merkle_manifest(spark, sf)
    want = sorted((tuple(r) for r in con.execute(M.OP13_SQL).fetchall()), key=repr)
    assert sorted((tuple(r) for r in df.collect()), key=repr) == want
