"""Benchmark decontamination against a plain window search."""

import hashlib
import random
import re

import pytest

from textrisk.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, bench, width=10):
    wins = {}
    for item, text in bench:
        ws = plain_words(text)
        n = min(width, len(ws))
        for i in range(len(ws) - n + 1 if n else 0):
            wins.setdefault(tuple(ws[i:i + n]), set()).add(item)
    out = []
    for d, text in docs:
        ws, hit, items = plain_words(text), set(), set()
        for n in {len(w) for w in wins}:
            for i in range(len(ws) - n + 1):
                own = wins.get(tuple(ws[i:i + n]))
                if own is not None:
                    hit.update(range(i, i + n))
                    items |= own - {None}
        ids = ",".join(sorted(map(str, items)))
        out.append((d, len(ws), len(hit), len(items), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def save(spark, folder, docs, bench):
    spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, spans string, items int").write.parquet(
        f"{folder}/documents.parquet")
    spark.createDataFrame([(*b, 1) for b in bench], "item_id long, text string, run int").write.parquet(
        f"{folder}/benchmark.parquet")


def run(spark, folder):
    return sorted((tuple(r) for r in D.op11_benchmark_decontamination(spark, str(folder)).collect()), key=repr)


def random_tables(seed, words=("a", "bb", "Ccc", "été", "x9", "日本")):
    r = random.Random(seed)

    def text(n):
        return "".join(r.choice(words) + r.choice([" ", ", ", "\n", "--", "_"]) for _ in range(n))

    bench = [(i, text(r.choice([0, 1, 2, 5, 9, 10, 11, 30]))) for i in range(12)]
    docs = []
    for i in range(40):
        t = text(r.randrange(60))
        if i % 3 == 0:
            t += " " + r.choice(bench)[1].upper() + " " + text(4)
        docs.append((i, t))
    return docs, bench


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_plain_search(spark, tmp_path, seed):
    docs, bench = random_tables(seed, tuple(f"w{i}" for i in range(40)) if seed == 2 else ("a", "bb", "Ccc", "été", "日本"))
    bench += [(None, "null item words here " * 3), (3, "a second text of item three with more than ten words in it"), (50, None)]
    docs += [(100, None), (101, ""), (102, " .,; "), (None, "null item words here null"), (7, docs[7][1]), (7, "other"),
             (103, "The A SECOND text of item three with more than ten words in it, yes"), (104, "a " * 60_000)]
    save(spark, tmp_path, docs, bench)
    assert run(spark, tmp_path) == brute(docs, bench)


def test_parts_are_united(spark, tmp_path):
    """Many passes over the texts find what one pass finds."""
    docs, bench = random_tables(3, tuple(f"v{i}" for i in range(30)))
    docs += [docs[0], docs[0], (None, docs[0][1])]
    save(spark, tmp_path, docs, bench)
    d, b = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "benchmark"))
    one = sorted((tuple(r) for r in D.contaminated(d, b).collect()), key=repr)
    many = sorted((tuple(r) for r in D.contaminated(d, b, max_windows=25).collect()), key=repr)
    assert one == many and any(r[2] for r in one)


def test_empty_tables(spark, tmp_path):
    save(spark, tmp_path / "a", [], [(1, "one two")])
    assert run(spark, tmp_path / "a") == []
    save(spark, tmp_path / "b", [(1, "one two")], [])
    assert run(spark, tmp_path / "b") == brute([(1, "one two")], [])


def test_search_finds_every_occurrence_and_only_those():
    r = random.Random(5)
    for _ in range(200):
        strings = {bytes(r.choice(b"ab ") for _ in range(r.randrange(1, 14))) for _ in range(r.randrange(1, 12))}
        text = bytes(r.choice(b"ab ") for _ in range(r.randrange(0, 80)))
        want = sorted((i, s) for s in strings for i in range(len(text)) if text.startswith(s, i))
        assert sorted(D.WuManber(list(strings)).find(text)) == want


def test_long_shifts_skip_most_positions():
    class Seen(bytearray):
        looks = 0

        def __getitem__(self, i):
            Seen.looks += 1
            return super().__getitem__(i)

    search = D.WuManber([D.spaced([b"word%d" % (i + k) for k in range(10)]) for i in range(100)])
    search.groups = [(m, b, k, Seen(s), t) for m, b, k, s, t in search.groups]
    assert not search.find(b" quite another text" * 1000) and Seen.looks < 19_000 / 20


def test_driver_table_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = sorted((tuple(r) for r in con.execute(D.OP11_SQL).fetchall()), key=repr)
    got = run(spark, sf)
    assert got == want and any(r[5] for r in got) and not all(r[5] for r in got)
