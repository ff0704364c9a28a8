import random
import re

import numpy as np
import pytest

from textrisk.llm import jaccard_join
from textrisk.llm.jaccard_join import CountForest, components, jaccard_components, needed, point, prefix_length, shingles


def brute(rows, n=5, percent=75):
    def shingle_set(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(w)} if 0 < len(w) < n else {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}
    sets = [shingle_set(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if (sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None
                    and 100 * both >= percent * len(sets[i] | sets[j])):
                label[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(root(i), []).append(d)
    return sorted(((d, len(sets[i]), None if d is None else min(least[root(i)])) for i, (d, _) in enumerate(rows)), key=repr)


def corpus(seed, copies=25):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = [rnd.choice(vocabulary) for _ in range(30)]
    rows = []
    for d in range(12):
        words = [rnd.choice(vocabulary) for _ in range(rnd.choice([8, 20, 60, 150]))]
        if d % 2:
            words += passage
        rows.append(words)
    for _ in range(copies):  # chains of edits, so that components hold unlinked pairs
        words = list(rnd.choice(rows))
        for _ in range(rnd.randint(0, 3)):
            words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        rows.append(words)
    return [(100 - i, " ".join(w)) for i, w in enumerate(rows)]


EDGE = [(1, None), (2, ""), (3, " \n\t"), (4, "One two"), (5, "one TWO"), (6, "one two three"), (7, "a b c d e"),
        (7, "a b c d e"), (7, "other words stand here now"), (None, "a b c d e"), (None, None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_brute_force(docs_of, as_rows, seed):
    rows = corpus(seed) + EDGE
    assert as_rows(jaccard_components(docs_of(rows).repartition(3))) == brute(rows)


def test_frequent_hashes_and_long_blocks_change_nothing(docs_of, as_rows, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FREQUENT", 2)
    monkeypatch.setattr(jaccard_join, "LEAF_BLOCK", 3)
    rows = corpus(3, copies=40)
    assert as_rows(jaccard_components(docs_of(rows))) == brute(rows)


def test_empty_table(docs_of):
    assert jaccard_components(docs_of([])).collect() == []


def test_forest_search_is_the_bound():
    rnd = np.random.default_rng(5)
    sets = [np.unique(rnd.integers(0, 2 ** 63, size=s).astype(np.uint64)) for s in rnd.integers(1, 200, size=450)]
    points, sizes = np.stack([point(s) for s in sets]), np.array([len(s) for s in sets])
    blocks = rnd.choice([3, 3, 3, 5, 9, 70, 71], size=450)
    q, at = CountForest(points, sizes, blocks).search(points, sizes, blocks)
    got = set(zip(q.tolist(), at.tolist(), strict=True))
    want = set()
    for i in range(450):
        bound = np.minimum(points, points[i]).sum(axis=1)
        ok = ((blocks == blocks[i]) & (100 * sizes >= 75 * sizes[i]) & (75 * sizes <= 100 * sizes[i])
              & (bound >= needed(sizes, sizes[i])))
        want |= {(i, j) for j in np.flatnonzero(ok).tolist()}
    assert got == want
    none = CountForest(points[:1], sizes[:1], blocks[:1]).search(points[:0], sizes[:0], blocks[:0])
    assert len(none[0]) == 0


def test_sets_too_large_for_a_point_pass():
    rnd = np.random.default_rng(6)
    sets = [np.unique(rnd.integers(0, 2 ** 64, size=s, dtype=np.uint64)) for s in (5000, 5000, 6000, 300)]
    points, sizes, blocks = np.stack([point(s) for s in sets]), np.array([len(s) for s in sets]), np.zeros(4, dtype=int)
    q, at = CountForest(points, sizes, blocks).search(points, sizes, blocks)
    assert {(0, 1), (0, 2), (2, 1), (3, 3)} <= set(zip(q.tolist(), at.tolist(), strict=True))
    rows = jaccard_join._unpacked([jaccard_join._packed(p) for p in points])
    assert sorted(rows[3]) == sorted(points[3]) and (np.minimum(rows[0], rows[3]).sum() == len(sets[3]))


def test_linked_sets_share_a_first_hash():
    rnd = random.Random(4)
    for _ in range(200):
        a = rnd.sample(range(400), rnd.randint(1, 60))
        b = [x for x in a if rnd.random() > 0.1] + rnd.sample(range(400, 800), rnd.randint(0, 5))
        if b and 100 * len(set(a) & set(b)) >= 75 * len(set(a) | set(b)):
            assert set(sorted(a)[:prefix_length(len(a))]) & set(sorted(b)[:prefix_length(len(b))])


def test_chain_of_links(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90)], "a long, b long")
    got = dict(tuple(r) for r in components(links).collect())
    assert got == {**dict.fromkeys(range(41), 0), 90: 90, 100: 90}


def test_shingles_of_few_words():
    assert len(shingles("a b")) == 1 and len(shingles("a b c d e f")) == 2 and len(shingles(" ")) == 0
    assert shingles("a b")[0] != shingles("a b c")[0]


def test_classes_whose_names_collide_stay_apart(docs_of, as_rows, monkeypatch):
    whole = jaccard_join.set_class
    monkeypatch.setattr(jaccard_join, "set_class", lambda hashes: (whole(hashes)[0] % 3, whole(hashes)[1]))
    rows = corpus(5) + EDGE
    assert as_rows(jaccard_components(docs_of(rows))) == brute(rows)


def test_pairs_of_a_group_of_copies_grow_in_proportion(docs_of, as_rows, monkeypatch):
    """Copies of one text, each with edits of its own, link to it and mostly not to each other."""
    rnd = random.Random(8)
    source = [f"w{i}" for i in range(120)]

    def copies(n):
        rows = [(0, " ".join(source))]
        for i in range(1, n):
            words = list(source)
            for k in range(3):
                words[rnd.randrange(40 * k, 40 * k + 40)] = f"own{i}x{k}"
            rows.append((i, " ".join(words)))
        return rows

    tried, whole = [], jaccard_join._verified

    def counting(pairs, *rest):
        found = whole(pairs, *rest)
        tried.append(found._tried)
        return found

    monkeypatch.setattr(jaccard_join, "_verified", counting)
    sums = []
    for n in (40, 160):
        rows = copies(n)
        tried.clear()
        assert {r[2] for r in as_rows(jaccard_components(docs_of(rows)))} == {0}
        sums.append(sum(tried))
    assert sums[1] <= 6 * sums[0]


def test_signatures_bound_the_overlap(monkeypatch):
    rnd = np.random.default_rng(2)
    for size in (0, 1, 300, 5000):
        a = np.unique(rnd.integers(0, 2 ** 64, size=size, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: len(a) * 4 // 5], rnd.integers(0, 2 ** 64, size=size // 5, dtype=np.uint64)]))
        true = len(np.intersect1d(a, b))
        for short in (100, 4096, len(b) - 1, 10 ** 6):  # also signatures of two widths
            monkeypatch.setattr(jaccard_join, "SHORT_SET", short)
            got = jaccard_join.overlap_bound(jaccard_join.signature(a), jaccard_join.signature(b), len(a), len(b))
            assert true <= got <= true + max(3, size)
    twice = np.array([7 << 48, (7 << 48) + 1, (7 << 48) + 2], dtype=np.uint64)
    assert jaccard_join.overlap_bound(jaccard_join.signature(twice), jaccard_join.signature(twice[:2]), 3, 2) == 2


def test_a_pair_is_taken_from_its_first_block(spark, docs_of, as_rows, monkeypatch):
    """Copies of a text, some with too many edits of their own to link: a pair made one row for each block it shares."""
    rnd = random.Random(9)
    source = [f"w{i}" for i in range(200)]
    rows = [(0, " ".join(source))]
    for i in range(1, 40):
        words = list(source)
        for k in rnd.sample(range(0, 200, 10), 8 if i % 3 else 3):
            words[k] = f"own{i}x{k}"
        rows.append((i, " ".join(words)))
    made, whole = [], jaccard_join._searched

    def counting(blocks, points, percent):
        found = jaccard_join.written(whole(blocks, points, percent), "found")
        made.append((found.count(), found.select("a", "b").distinct().count(), blocks.select("cls").distinct().count()))
        return found

    monkeypatch.setattr(jaccard_join, "FREQUENT", 2)
    monkeypatch.setattr(jaccard_join, "_searched", counting)
    assert as_rows(jaccard_components(docs_of(rows))) == brute(rows)
    found, pairs, classes = made[0]
    assert classes > 20 and found <= 2 * pairs


@pytest.mark.parametrize("before", [0, 1, 4])
def test_every_linked_pair_is_found(spark, monkeypatch, before):
    """All pairs of sets that link come out of the search, however few of the blocks before are known."""
    monkeypatch.setattr(jaccard_join, "BEFORE", before)
    monkeypatch.setattr(jaccard_join, "LEAF_BLOCK", 7)
    rnd = np.random.default_rng(11)
    base = [np.unique(rnd.integers(0, 2 ** 63, size=s).astype(np.uint64)) for s in (5, 40, 120)]
    sets = []
    for _ in range(60):
        s = base[rnd.integers(3)]
        own = rnd.integers(0, 2 ** 63, size=rnd.integers(0, 1 + len(s) // 6)).astype(np.uint64)
        sets.append(np.unique(np.concatenate([s[rnd.random(len(s)) > rnd.random() * 0.2], own])))
    sets = list({s.tobytes(): s for s in sets if len(s)}.values())
    entries = [(int(k), c, len(s), c, p) for c, s in enumerate(sets) for p, k in enumerate(s[:prefix_length(len(s))])]
    seen = [k for k, *_ in entries]
    twice = {k for k in seen if seen.count(k) > 1}
    blocks = spark.createDataFrame([e for e in entries if e[0] in twice], "key long, cls long, size int, comp long, pos int")
    points = spark.createDataFrame([(c, jaccard_join._packed(point(s))) for c, s in enumerate(sets)], "cls long, points binary")
    got = {tuple(r) for r in jaccard_join._searched(blocks, points, 75).select("a", "b").collect()}
    want = {(a, b) for b in range(len(sets)) for a in range(b)
            if 100 * (o := len(np.intersect1d(sets[a], sets[b]))) >= 75 * (len(sets[a]) + len(sets[b]) - o)}
    assert len(want) > 10 and want <= got
