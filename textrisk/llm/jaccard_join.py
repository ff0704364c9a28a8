"""N-gram Jaccard join with a count-vector R-tree.

A document's set holds its distinct ``n``-word shingles as 64-bit hashes. Hashes
dealt into ``GROUPS`` groups make a point of group counts; the summed minima of two
points bound the overlap of their sets, and the maximum corner of a tree node bounds
the overlap with everything below it.

1. Equal sets become one class, told apart by a 128-bit digest of the sorted set.
2. Blocks: two sets that link share one of their ``|A| - ceil(t|A|) + 1`` first
   hashes under any common order. Here frequent hashes come last (a bounded sample of
   documents says which: this moves cost, never a result), then by value. A hash that
   only one class has is dropped at once.
3. First links: each class is tried with the pivot it shares most blocks with, and in wide
   blocks with further ones; verified pairs are joined into components, so that large
   groups of near copies never need all their pairs.
4. All remaining pairs between different components: each block with more than one
   component bulk-loads an R-tree over its points and queries it with each of them.
   A long block is cut into runs of ``LEAF_BLOCK`` points by size, and each pair of
   runs whose sizes can link is a task of its own.
   A pair is taken from the first block it shares, not from each: there, what both sets
   have from the block's hash on must reach the needed overlap, and so must the blocks both
   still have + what lies behind their first hashes (exact bounds). A pair that shares one
   of the ``BEFORE`` open blocks before has been taken already.
5. The pairs left are ruled out by signatures or verified on their whole sets.

Defined results: null, empty or blank text has the empty set and links with nothing
(its own component); fewer than ``n`` words are one shingle; every row is a node of its
own, also where rows repeat a doc_id (with the same text or another); a null doc_id is
never linked and has a null component. Empty tables give empty results. Other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textrisk.llm.common import dropped, lower_ascii, table, worker_cache, written

N = 5
PERCENT = 75
GROUPS = 256
MOST = 15
LEAF = 16
LEAF_BLOCK = 2048
QUERIES = 1024  # queries that go down a forest together
PAIRS = 20_000  # bounds computed at a time
TEXTS = 200  # texts handled at a time in a task
FEW = 500_000  # classes whose texts are picked out by a broadcast
SAMPLE_DOCS = 10_000
FREQUENT = 3  # documents of the sample
WIDE = 32  # classes of a block that gets further rounds of first links
ROUNDS = 8
ALIKE = 60  # percent of the first hashes that a class and the pivot it tries share
SHORT_SET = 4096  # sets up to this size have 16-bit signatures, longer ones 32-bit
MIX = np.uint64(0x9E3779B97F4A7C15)
BEFORE = 4  # open blocks of a class before a block that tell whether a pair shares an earlier one
CACHE_WORDS = 150_000


def shingles(text: str | None, n: int = N) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``n``-word shingles of a lower-cased text."""
    # bytes.split() cuts at exactly 0x20 and 0x09-0x0D.
    found = (text or "").encode("utf-8", "surrogatepass").split()
    if not found:
        return np.empty(0, dtype=np.uint64)
    known = worker_cache("ngram-jaccard")
    if len(known) > CACHE_WORDS:
        known.clear()
    for w in set(found):
        if w not in known:
            known[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(known.__getitem__, found), dtype=np.uint64, count=len(found))
    width = min(n, len(h))
    out = np.full(len(h) - width + 1, len(h) if len(h) < n else n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):  # one strong mixing step per word
            out = (out ^ h[i:i + len(out)]) * MIX
            out ^= out >> np.uint64(29)
            out *= np.uint64(0xBF58476D1CE4E5B9)
            out ^= out >> np.uint64(32)
    return np.unique(out)


def needed(a, b, percent: int = PERCENT):
    """Smallest overlap with percent * |A or B| <= 100 * |A and B|."""
    return -(-(percent * (a + b)) // (100 + percent))


def prefix_length(size: int, percent: int = PERCENT) -> int:
    return size - -(-percent * size // 100) + 1 if size else 0


def point(hashes: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """Counts per group of 4 bits; a set with a larger one has them all at the most, which bounds nothing."""
    counts = np.bincount((hashes >> np.uint64(32)) % np.uint64(groups), minlength=groups)
    return (counts if counts.max() <= MOST else np.full(groups, MOST)).astype(np.uint8)


def _packed(counts: np.ndarray) -> bytes:
    return (counts[0::2] | counts[1::2] << 4).tobytes()


def _unpacked(points: pd.Series) -> np.ndarray:
    pairs = np.frombuffer(b"".join(points), dtype=np.uint8).reshape(len(points), -1)
    return np.concatenate([pairs & 15, pairs >> 4], axis=1)


def signature(hashes: np.ndarray) -> bytes:
    """The sorted upper bits of all hashes, equal ones repeated."""
    return (hashes >> np.uint64(48)).astype("<u2").tobytes() if len(hashes) <= SHORT_SET else (
        hashes >> np.uint64(32)).astype("<u4").tobytes()


def _numbered(bits: np.ndarray) -> np.ndarray:
    """Distinct values: each with the number of equal ones before it."""
    at = np.arange(len(bits))
    first = np.maximum.accumulate(np.where(np.r_[True, bits[1:] != bits[:-1]], at, 0))
    return bits.astype(np.int64) << 32 | at - first


def overlap_bound(a: bytes, b: bytes, size_a: int, size_b: int) -> int:
    """At least the overlap of the two sets: equal hashes have equal upper bits."""
    x, y = (np.frombuffer(z, dtype="<u2" if n <= SHORT_SET else "<u4") for z, n in ((a, size_a), (b, size_b)))
    if x.dtype != y.dtype:
        x, y = (v if v.dtype.itemsize == 2 else v >> np.uint32(16) for v in (x, y))
    return len(np.intersect1d(_numbered(x), _numbered(y), assume_unique=True))


class CountForest:
    """Bulk-loaded R-trees over group-count points, one tree per block: leaves are runs
    in order of set size, every node keeps its maximum corner and its range of sizes.
    All queries of all blocks go down together, level by level."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, blocks: np.ndarray, percent: int = PERCENT,
                 left: np.ndarray | None = None):
        """``left``: how many hashes of each set a partner can have at most (none given: all)."""
        self.percent, self.order = percent, np.lexsort((sizes, blocks))
        corner, low, block = points[self.order], sizes[self.order], blocks[self.order]
        high, most = low, (sizes if left is None else left)[self.order]
        self.levels = [(corner, low, high, most, None, None)]
        while True:
            starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
            if len(starts) == len(block) and len(self.levels) > 1:
                break
            lengths = np.diff(np.r_[starts, len(block)])
            nodes = -(-lengths // LEAF)
            first = np.repeat(starts, nodes) + LEAF * _count_up(nodes)
            count = np.diff(np.r_[first, len(block)])
            corner = np.maximum.reduceat(corner, first, axis=0)
            low, high, most = np.minimum.reduceat(low, first), np.maximum.reduceat(high, first), np.maximum.reduceat(most, first)
            block = np.repeat(block[starts], nodes)
            self.levels.append((corner, low, high, most, first, count))
        self.root = block

    def search(self, points: np.ndarray, sizes: np.ndarray, blocks: np.ndarray,
               left: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query, point) positions of all pairs of a block whose bounds let them link."""
        left = sizes if left is None else left
        out = [self._search(points, sizes, blocks, left, np.arange(a, min(a + QUERIES, len(sizes))))
               for a in range(0, len(sizes), QUERIES)]
        return (np.concatenate([q for q, _ in out]), np.concatenate([p for _, p in out])) if out else (
            np.empty(0, dtype=np.int64),) * 2

    def _search(self, points, sizes, blocks, left, q):
        at = np.searchsorted(self.root, blocks[q])
        known = (at < len(self.root)) & (self.root[np.minimum(at, len(self.root) - 1)] == blocks[q])
        q, at = q[known], at[known]
        for corner, low, high, most, first, count in reversed(self.levels):
            size = sizes[q]
            need = needed(np.maximum(low[at], -(-self.percent * size // 100)), size, self.percent)
            fits = ((100 * high[at] >= self.percent * size) & (self.percent * low[at] <= 100 * size)
                    & (np.minimum(most[at], left[q]) >= need))
            q, at, need = q[fits], at[fits], need[fits]
            need = np.minimum(need, MOST * corner.shape[1])  # sets too large for a point pass
            keep = np.concatenate([np.minimum(corner[at[i:i + PAIRS]], points[q[i:i + PAIRS]]).sum(axis=1, dtype=np.int64)
                                   for i in range(0, len(q), PAIRS)] or [np.empty(0)]) >= need
            q, at = q[keep], at[keep]
            if first is not None:
                below = count[at]
                at = np.repeat(first[at], below) + _count_up(below)
                q = np.repeat(q, below)
        return q, self.order[at]


def _count_up(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ..., n-1 for each n of lengths, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def set_class(hashes: np.ndarray) -> tuple[int, int]:
    """The two halves of a 128-bit digest of a sorted set."""
    return tuple(np.frombuffer(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest(), dtype="<i8").tolist())


def _sets(texts: DataFrame, frequent, n: int, percent: int) -> DataFrame:
    """(doc, size, cls, half, points, keys): one row per row of texts. ``points`` and ``keys``, the
    first hashes of the set, are given once per class and task."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        late, done = frequent.value, set()
        for f in (f.iloc[a:a + TEXTS] for f in frames for a in range(0, len(f), TEXTS)):
            rows = []
            for i, t in zip(f["i"], f["t"], strict=True):
                s = shingles(t, n)
                cls, keys, points = set_class(s), None, None
                if len(s) and not pd.isna(i) and cls not in done:
                    done.add(cls)
                    keys = s
                    if len(late):
                        is_late = late[np.minimum(np.searchsorted(late, s), len(late) - 1)] == s
                        keys = np.concatenate([s[~is_late], s[is_late]])
                    keys = keys[:prefix_length(len(s), percent)].astype(np.int64)
                    points = _packed(point(s))
                rows.append((len(s), *cls, points, keys))
            out = pd.DataFrame(rows, columns=["size", "cls", "half", "points", "keys"])
            out.insert(0, "doc", pd.array(f["i"], dtype="Int64"))
            yield out

    return texts.mapInPandas(run, "doc long, size long, cls long, half long, points binary, keys array<long>")


def _named(sets: DataFrame) -> DataFrame:
    """``sets`` whose ``cls`` tells classes apart: where two digests agree in the first half, all but one
    get another name. (With 10^10 classes a few pairs do.)"""
    attempt = 0
    while True:
        halves = sets.where("size > 0").select("cls", "half").distinct()
        twice = halves.groupBy("cls").agg(F.min("half").alias("least"), F.max("half").alias("most")).where("least <> most")
        if twice.isEmpty():
            return sets
        attempt += 1
        sets = written(sets.join(twice.select("cls", "least"), "cls", "left").select(
            "doc", "size", F.when(F.col("half") > F.col("least"), F.xxhash64("cls", "half", F.lit(attempt))).otherwise(
                F.col("cls")).alias("cls"), "half", "points", "keys"), "sets")


def _frequent(texts: DataFrame, n: int) -> np.ndarray:
    """Hashes that many documents of a bounded sample have, sorted. At most
    SAMPLE_DOCS * (hashes per document) / FREQUENT entries."""
    rate = min(1.0, SAMPLE_DOCS / max(1, texts.select("i").count()))
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(3), F.col("i")), 11) / F.lit(float(2 ** 53))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            sets = [shingles(t, n) for t in f["t"]]
            if sets:
                h, c = np.unique(np.concatenate(sets), return_counts=True)
                yield pd.DataFrame({"h": h.astype(np.int64), "c": c})

    found = (texts.where(unit < rate).select("t").distinct()
             .mapInPandas(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
             .where(F.col("c") >= FREQUENT).select("h").toPandas())
    return np.sort(found["h"].to_numpy(dtype=np.int64).astype(np.uint64))


def _representatives(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(cls, half, i): the classes of the pairs and their smallest documents, written."""
    wanted = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
    return written(classes.join(wanted, "cls", "left_semi").select("cls", "half", F.col("rep").alias("i")), "wanted")


def _texts_of(texts: DataFrame, reps: DataFrame) -> DataFrame:
    """(t, cls, half): the texts of the representatives. Up to ``FEW`` of them (24 bytes each) are broadcast, so
    that no other text moves; more are joined by a shuffle."""
    few = F.broadcast(reps) if reps.count() <= FEW else reps
    return texts.join(few, "i").select("t", "cls", "half")


def _packed_texts(texts: DataFrame, reps: DataFrame) -> DataFrame:
    """(cls, half, packed): the compressed text of each wanted class's smallest document; a row
    that repeats that doc_id with another text comes along and is told apart later."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in (f.iloc[a:a + TEXTS] for f in frames for a in range(0, len(f), TEXTS)):
            yield pd.DataFrame({"cls": f["cls"], "half": f["half"], "packed": [
                zlib.compress(t.encode("utf-8", "surrogatepass"), 3) for t in f["t"]]})

    return _texts_of(texts, reps).mapInPandas(run, "cls long, half long, packed binary")


def _possible(pairs: DataFrame, texts: DataFrame, classes: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose signatures do not rule a link out, written; each class is cut into
    shingles once."""
    def sign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in (f.iloc[x:x + TEXTS] for f in frames for x in range(0, len(f), TEXTS)):
            rows = []
            for t, cls, half in zip(f["t"], f["cls"], f["half"], strict=True):
                s = shingles(t, n)
                if set_class(s)[1] == half:  # else a row that repeats the doc_id with another text
                    rows.append((cls, len(s), signature(s)))
            yield pd.DataFrame(rows, columns=["cls", "size", "bits"])

    def bound(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            keep = [100 * o >= percent * (na + nb - o) for o, na, nb in (
                (overlap_bound(x, y, na, nb), na, nb)
                for x, y, na, nb in zip(f["xa"], f["xb"], f["na"], f["nb"], strict=True))]
            yield f.loc[np.array(keep, dtype=bool), ["a", "b"]]

    reps = _representatives(classes, pairs)
    signed = written(_texts_of(texts, reps).mapInPandas(
        sign, "cls long, size long, bits binary").dropDuplicates(["cls"]), "signatures")
    rows = pairs
    for side in "ba":
        rows = rows.join(signed.toDF(side, f"n{side}", f"x{side}"), side)
    out = written(rows.select("a", "b", "na", "nb", "xa", "xb").mapInPandas(bound, "a long, b long"), "possible")
    dropped(signed, reps)
    return out


def _verified(pairs: DataFrame, texts: DataFrame, classes: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets link, written. Only signatures of classes in a pair
    move, and whole texts of those that may still link."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def unpack(z: bytes) -> np.ndarray:
            return shingles(zlib.decompress(z).decode("utf-8", "surrogatepass"), n)

        last: tuple = (None, None, None)  # rows come in order of a
        for f in (f.iloc[x:x + TEXTS] for f in frames for x in range(0, len(f), TEXTS)):
            keep = []
            for a, b, ta, tb, ha, hb in zip(f["a"], f["b"], f["ta"], f["tb"], f["ha"], f["hb"], strict=True):
                if last[0] != a:
                    last = (a, unpack(ta), ta)
                sa, sb = last[1] if last[2] == ta else unpack(ta), unpack(tb)
                both = len(np.intersect1d(sa, sb, assume_unique=True))
                keep.append(100 * both >= percent * (len(sa) + len(sb) - both)
                            and set_class(sa)[1] == ha and set_class(sb)[1] == hb)
            yield f.loc[np.array(keep, dtype=bool), ["a", "b"]]

    pairs = written(pairs, "pairs")
    possible = _possible(pairs, texts, classes, n, percent)
    reps = _representatives(classes, possible)
    packed = written(_packed_texts(texts, reps), "pair-texts")
    rows = possible
    for side in "ba":
        rows = rows.join(packed.toDF(side, f"h{side}", f"t{side}"), side)
    links = written(rows.select("a", "b", "ta", "tb", "ha", "hb").mapInPandas(run, "a long, b long").distinct(), "links")
    links._tried = pairs.count()
    dropped(pairs, possible, packed, reps)
    return links


def components(links: DataFrame) -> DataFrame:
    """(node, label) of all nodes of ``links`` (a, b): label is the smallest node
    reachable. Labels spread over links and jump to their own label each round."""
    edges = written(links.union(links.select("b", "a")).toDF("u", "v").distinct(), "links")
    labels = written(edges.groupBy("u").agg(F.min("v").alias("m"))
                     .select(F.col("u").alias("node"), F.least("u", "m").alias("label"),
                             F.least("u", "m").alias("next")), "labels")
    while True:
        at = labels.select("node", F.col("next").alias("label"))
        near = (edges.join(at, edges["v"] == at["node"]).groupBy("u").agg(F.min("label").alias("near")))
        step = at.join(near, at["node"] == near["u"]).select(
            "node", "label", F.least("label", "near").alias("next"))
        jump = step.select(F.col("node").alias("at"), F.col("next").alias("far"))
        moved = written(step.join(jump, step["next"] == jump["at"]).select(
            "node", "label", F.least("next", "far").alias("next")), "labels")
        dropped(labels)
        labels = moved
        if moved.where("next <> label").isEmpty():
            dropped(edges)
            return moved.select("node", F.col("next").alias("label"))


def _searched(blocks: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of different components that share a block and pass the tree's bounds, from the first block
    they share. No hash before that block's is in both sets, so that each must have enough of the
    needed overlap from there on (``left``, and of open blocks ``more``). In a later block a pair may come again, where neither has a block
    in common with the other among its last ``BEFORE``."""
    by_size = Window.partitionBy("key").orderBy("size", "cls")
    by_place = Window.partitionBy("cls").orderBy("pos")
    place = F.row_number().over(by_place) - 1
    rows = blocks.select("key", "cls", "size", "comp", (F.col("size") - F.col("pos")).alias("left"), (
        F.count(F.lit(1)).over(Window.partitionBy("cls")) - place).alias("more"), F.least(place, F.lit(BEFORE)).alias("known"), *(
        F.coalesce(F.lag("key", k + 1).over(by_place), F.lit(0)).alias(f"before{k}") for k in range(BEFORE)))
    rows = rows.withColumn("run", F.floor((F.row_number().over(by_size) - 1) / LEAF_BLOCK).cast("int"))
    spans = rows.groupBy("key", "run").agg(F.min("size").alias("lo"), F.max("size").alias("hi"))
    left = spans.select("key", "run", "lo", "hi")
    right = spans.select(F.col("key").alias("k2"), F.col("run").alias("run2"), F.col("lo").alias("lo2"))
    # Pairs of runs, not of rows: one per block unless a block is longer than LEAF_BLOCK.
    tiles = left.join(right, (F.col("key") == F.col("k2")) & (F.col("run") <= F.col("run2"))
                      & (F.col("lo2") * percent <= F.col("hi") * 100)).select("key", "run", "run2")
    sides = tiles.select("key", F.col("run").alias("r1"), F.col("run2").alias("r2"),
                         F.explode(F.array_distinct(F.array("run", "run2"))).alias("run"))
    dealt = rows.join(sides, ["key", "run"]).join(points, "cls")

    earlier = [f"before{k}" for k in range(BEFORE)]

    def search(f: pd.DataFrame) -> pd.DataFrame:
        pts = _unpacked(f["points"])
        sizes, comp, cls, run, left, more, known = (
            f[c].to_numpy() for c in ("size", "comp", "cls", "run", "left", "more", "known"))
        before = [f[c].to_numpy() for c in earlier]
        tile = f.groupby(["key", "r1", "r2"], sort=False).ngroup().to_numpy()
        index, query = np.flatnonzero(run == f["r2"].to_numpy()), np.flatnonzero(run == f["r1"].to_numpy())
        forest = CountForest(pts[index], sizes[index], tile[index], percent, left[index])
        i, j = forest.search(pts[query], sizes[query], tile[query], left[query])
        i, j = query[i], index[j]
        fits = (comp[i] != comp[j]) & ((run[i] != run[j]) | (cls[i] < cls[j]))
        i, j = i[fits], j[fits]
        behind = -(-percent * np.maximum(sizes[i], sizes[j]).astype(np.int64) // 100) - 1
        fits = np.minimum(more[i], more[j]) + behind >= needed(sizes[i].astype(np.int64), sizes[j], percent)
        i, j = i[fits], j[fits]
        taken = np.zeros(len(i), dtype=bool)
        for x, y in itertools.product(range(BEFORE), repeat=2):
            taken |= (before[x][i] == before[y][j]) & (x < known[i]) & (y < known[j])
        i, j = i[~taken], j[~taken]
        swap = cls[i] > cls[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        return pd.DataFrame({"a": cls[i], "b": cls[j]})

    def search_all(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come in order of their tile; a batch is searched up to its last whole tile
        (a tile has at most 2 * LEAF_BLOCK rows)."""
        rest = None
        for f in frames:
            f = f if rest is None else pd.concat([rest, f], ignore_index=True)
            last = (f[["key", "r1", "r2"]] == f[["key", "r1", "r2"]].iloc[-1]).all(axis=1).to_numpy() if len(f) else None
            rest = f[last] if len(f) else None
            if len(f) and not last.all():
                yield search(f[~last].reset_index(drop=True))
        if rest is not None and len(rest):
            yield search(rest.reset_index(drop=True))

    tile = ["key", "r1", "r2"]
    return dealt.select("cls", "size", "left", "more", "known", *earlier, "comp", "run", "points", *tile).repartition(
        *tile).sortWithinPartitions(*tile).mapInPandas(search_all, "a long, b long")


def _reachable(percent: int):
    """Exact: shared first hashes plus all hashes behind them reach the needed overlap."""
    def behind(s):
        return F.ceil(F.col(s) * percent / 100) - 1
    need = F.ceil(F.lit(percent) * (F.col("sa") + F.col("sb")) / (100 + percent))
    return F.col("shared") + F.greatest(behind("sa"), behind("sb")) >= need


def _tries(blocks: DataFrame, pivots: DataFrame, percent: int) -> DataFrame:
    """(a, b): every class with the pivot of another component it shares most of its blocks with, if the two
    can link. ``blocks``: key, cls, size, comp; ``pivots``: (key, a)."""
    side = blocks.select("key", F.col("cls").alias("a"), F.col("size").alias("sa"), F.col("comp").alias("ca"))
    return (blocks.join(pivots.join(side, ["key", "a"]), "key").where("comp <> ca")
            .groupBy("a", F.col("cls").alias("b"), "sa", F.col("size").alias("sb"))
            .agg(F.count(F.lit(1)).alias("shared")).where(_reachable(percent))
            # Links share nearly all first hashes; what shares fewer is left to the search.
            .where(100 * F.col("shared") >= ALIKE * (F.least("sa", "sb") * (100 - percent) / 100))
            # Each class tries its best pivot only.
            .groupBy("b").agg(F.max_by("a", F.struct("shared", "a")).alias("a")).select("a", "b"))


def _first_links(blocks: DataFrame, texts: DataFrame, classes: DataFrame, n: int, percent: int) -> DataFrame:
    """Links that join most members of large groups of near copies, each class trying one pivot a round. The
    first pivot of a block is its class with the most company in all its blocks, such as the text the
    others were copied from; then blocks of ``WIDE`` classes and more, where the pairs left would
    grow with the square, try others of their largest component, while a tenth of the tries link."""
    alone = blocks.withColumn("comp", F.col("cls"))
    company = blocks.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    score = blocks.join(company, "key").groupBy("cls").agg(F.sum("n").alias("score"))
    pivots = blocks.join(score, "cls").groupBy("key").agg(F.max_by("cls", F.struct("score", "cls")).alias("a"))
    links = _verified(_tries(alone, pivots, percent), texts, classes, n, percent)
    wide = blocks.join(company.where(F.col("n") >= WIDE).select("key"), "key", "left_semi")
    for turn in range(ROUNDS):
        now = written(_with_components(wide, components(links)), "wide-blocks")
        parts = now.groupBy("key", "comp").agg(
            F.count(F.lit(1)).alias("n"), F.max_by("cls", F.xxhash64(F.lit(turn), "cls")).alias("a"))
        pivots = parts.groupBy("key").agg(F.max_by("a", F.struct("n", "comp")).alias("a"), F.max("n").alias("most"),
                                          F.sum("n").alias("all")).where("2 <= most and most < all").select("key", "a")
        more = _verified(_tries(now, pivots, percent), texts, classes, n, percent)
        tried = more._tried
        few = more.count() * 10 < tried
        both = written(links.unionByName(more), "links")
        dropped(now, more, links)
        links = both
        if few or not tried:
            break
    return links


def _with_components(blocks: DataFrame, parts: DataFrame) -> DataFrame:
    return blocks.join(parts.withColumnRenamed("node", "cls"), "cls", "left").select(
        "key", "cls", "size", F.coalesce("label", "cls").alias("comp"), "pos")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       n: int = N, percent: int = PERCENT) -> DataFrame:
    """(id_col, n_shingles, component_id): one row per row of ``docs``."""
    texts = docs.select(F.col(id_col).cast("long").alias("i"), lower_ascii(F.col(text_col)).alias("t"))
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(texts, n))
    sets = _named(written(_sets(texts, frequent, n, percent), "sets"))
    rows = written(sets.select("doc", "size", "cls", "half"), "rows")
    classes = written(rows.where("size > 0 and doc is not null").groupBy("cls").agg(
        F.min("doc").alias("rep"), F.first("half").alias("half")), "classes")
    near = Window.partitionBy("key").orderBy("cls")
    entries = (sets.where("keys is not null").select(F.posexplode("keys").alias("pos", "key"), "cls", F.col("size").cast("int"))
               .withColumn("prev", F.lag("cls").over(near)).withColumn("next", F.lead("cls").over(near)))
    blocks = written(entries.where("prev <> cls or next <> cls").select("key", "cls", "size", "pos").distinct(), "blocks")
    points = written(sets.where("points is not null").join(blocks.select("cls").distinct(), "cls", "left_semi")
                     .select("cls", "points").dropDuplicates(["cls"]), "points")
    dropped(sets)
    links = _first_links(blocks, texts, classes, n, percent)
    tagged = _with_components(blocks, components(links))
    mixed = tagged.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    open_blocks = written(tagged.join(mixed.select("key"), "key", "left_semi"), "open-blocks")
    dropped(blocks)
    more = _verified(_searched(open_blocks, points, percent).distinct(), texts, classes, n, percent)
    dropped(open_blocks, points)
    label = components(links.union(more)).withColumnRenamed("node", "cls")
    named = classes.join(label, "cls", "left").withColumn("part", F.coalesce("label", "cls"))
    least = named.groupBy("part").agg(F.min("rep").alias("least"))
    member = written(named.join(least, "part").select("cls", "least"), "members")
    placed = rows.where("size > 0 and doc is not null").join(member, "cls").select(
        "doc", "size", F.col("least").alias("component"))
    alone = rows.where("size = 0 or doc is null").select("doc", "size", F.col("doc").alias("component"))
    return placed.unionByName(alone).toDF(id_col, "n_shingles", "component_id")


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
