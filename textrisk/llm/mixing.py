"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong
to). The words of a pattern may be read up to ``max_repeats`` times; reading
them again costs more each time (convex costs 0, 1, 2, ...), so the flow from
patterns to source quotas repeats as little as it can. Of each pattern's flow,
whole readings go to all its documents; the rest goes to documents chosen in
seeded hash order, and inside the one hash bucket where the rest runs out, first
fit in that order and an exact subset sum over its last documents, so a pattern
comes within a few words of its flow.

Driver and single tasks hold patterns and one bucket (about ``BUCKET_DOCS``
documents, split by hash), never a pattern's documents. The number of patterns
is checked against ``MAX_PATTERNS``; more is an error, not a cut.

Defined results: null text has size 0; a null source is a source of its own,
after all others; a document of size 0 takes 0; repeated rows are documents of
their own (ties of hash and id get the same decision where they are identical).
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textrisk.llm.common import table, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
BUCKET_DOCS = 1000
SOLVED = 200
MAX_PATTERNS = 100_000


def water_fill(sizes: Sequence[int], weights: Sequence[float], repeats: int) -> list[float]:
    """Targets sharing sum(sizes) by weight, none above ``repeats`` times its size."""
    targets, active, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while active:
        unit = left / sum(weights[i] for i in active)
        full = [i for i in active if weights[i] * unit >= repeats * sizes[i]]
        if not full:
            for i in active:
                targets[i] = weights[i] * unit
            break
        for i in sorted(full):
            targets[i] = float(repeats * sizes[i])
            left -= targets[i]
            active.discard(i)
    return targets


def min_cost_flow(n: int, edges: list[list], source: int, sink: int) -> list[int]:
    """Successive cheapest paths; ``edges`` are [from, to, capacity, cost]. Returns
    the flow of each edge. The graph has patterns and sources, never documents."""
    graph: list[list[int]] = [[] for _ in range(n)]
    to, cap, cost = [], [], []
    for a, b, c, w in edges:
        for x, y, k, p in ((a, b, c, w), (b, a, 0, -w)):
            graph[x].append(len(to))
            to.append(y)
            cap.append(k)
            cost.append(p)
    while True:
        dist, via, queue, queued = [math.inf] * n, [-1] * n, deque([source]), [False] * n
        dist[source] = 0
        while queue:
            x = queue.popleft()
            queued[x] = False
            for e in graph[x]:
                if cap[e] and dist[x] + cost[e] < dist[to[e]]:
                    dist[to[e]], via[to[e]] = dist[x] + cost[e], e
                    if not queued[to[e]]:
                        queue.append(to[e])
                        queued[to[e]] = True
        if dist[sink] == math.inf:
            return [cap[2 * i + 1] for i in range(len(edges))]
        path, x = [], sink
        while x != source:
            path.append(via[x])
            x = to[via[x] ^ 1]
        push = min(cap[e] for e in path)
        for e in path:
            cap[e] -= push
            cap[e ^ 1] += push


def route(patterns: list[tuple[tuple, int]], quotas: dict, repeats: int) -> list[int]:
    """Words to take of each (member sources, size) pattern."""
    names = sorted(quotas, key=lambda s: (s is None, s or ""))
    at = {s: 1 + len(patterns) + i for i, s in enumerate(names)}
    sink = 1 + len(patterns) + len(names)
    edges: list[list] = []
    for i, (members, size) in enumerate(patterns):
        edges += [[0, 1 + i, size, r] for r in range(repeats)]
        edges += [[1 + i, at[s], repeats * size, 0] for s in members]
    edges += [[at[s], sink, quotas[s], 0] for s in names]
    flow, taken = min_cost_flow(sink + 1, edges, 0, sink), [0] * len(patterns)
    for (a, b, _, _), f in zip(edges, flow, strict=True):
        if a == 0:
            taken[b - 1] += f
    return taken


def fill(sizes: Sequence[int], left: int) -> list[int]:
    """Which of ``sizes`` (in seeded order) to take so that their sum comes as near
    below ``left`` as the last ``SOLVED`` of them allow: first fit over the others,
    then an exact subset sum (bit i of ``reach`` says that the sum i is reachable)."""
    taken, split = [0] * len(sizes), max(0, len(sizes) - SOLVED)
    for i in range(split):
        if 0 < sizes[i] <= left:
            taken[i], left = 1, left - sizes[i]
    mask, reach = (1 << (left + 1)) - 1, [1]
    for size in sizes[split:]:
        reach.append(reach[-1] | ((reach[-1] << size) & mask) if 0 < size <= left else reach[-1])
    total = reach[-1].bit_length() - 1
    for i in range(len(sizes) - 1, split - 1, -1):
        if not reach[i - split] >> total & 1:
            taken[i], total = 1, total - sizes[i]
    return taken


def _fill_bucket(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["_mx_hash", "_mx_id", "_mx_size"], kind="stable")
    left = int(rows["_mx_left"].iloc[0]) if len(rows) else 0
    return rows.assign(_mx_extra=fill(rows["_mx_size"].tolist(), left))[["_mx_row", "_mx_extra"]]


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: Sequence[float] = WEIGHTS, repeats: int = MAX_REPEATS, seed: int = 17) -> DataFrame:
    """(_mx_id, _mx_hash, _mx_members, size, source_size, target, taken, repeats): one row
    per row of ``docs``. ``source_col`` holds one source or an array of sources (an
    overlapping membership); source_size and target are then sums over the members.
    """
    spark = docs.sparkSession
    member = F.col(source_col)
    if not dict(docs.dtypes)[source_col].startswith("array"):
        member = F.array(member)
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    base = written(docs.select(
        F.col(id_col).alias("_mx_id"), F.array_sort(F.array_distinct(member)).alias("_mx_members"),
        size.alias("_mx_size"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("_mx_hash")
    ).withColumn("_mx_row", F.monotonically_increasing_id()), "mix-sizes")
    stats = (base.groupBy("_mx_members").agg(F.sum("_mx_size").alias("s"), F.count(F.lit(1)).alias("n"))
             .limit(MAX_PATTERNS + 1).collect())
    if len(stats) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    pats = sorted(((tuple(r["_mx_members"]), r["s"], r["n"]) for r in stats), key=lambda p: repr(p[0]))
    # Code point order, null last, for both the weights and the flow.
    names = sorted({s for p, _, _ in pats for s in p}, key=lambda s: (s is None, s or ""))
    sizes = [sum(s for p, s, _ in pats if name in p) for name in names]
    share = [weights[i % len(weights)] for i in range(len(names))]
    total = sum(s for _, s, _ in pats)
    targets = water_fill(sizes, share, repeats) if sum(sizes) == total else [
        min(t * total / max(1, sum(sizes)), repeats * z) for t, z in zip(water_fill(sizes, share, repeats), sizes, strict=True)]
    quota = {s: round(t) for s, t in zip(names, targets, strict=True)}
    flows = route([(p, s) for p, s, _ in pats], quota, repeats)
    size_of, target_of = dict(zip(names, sizes, strict=True)), dict(zip(names, targets, strict=True))
    rows = [(i, list(p), sum(size_of[s] for s in p), float(sum(target_of[s] for s in p)),
             f // s if s else 0, f % s if s else 0, max(1, n // BUCKET_DOCS))
            for i, ((p, s, n), f) in enumerate(zip(pats, flows, strict=True))]
    kind = base.schema["_mx_members"].dataType.simpleString()
    plan = F.broadcast(spark.createDataFrame(
        rows, f"_mx_pattern int, _mx_key {kind}, _mx_source_size long, _mx_target double, "
              "_mx_whole long, _mx_rest long, _mx_buckets long"))
    both = base.join(plan, base["_mx_members"] == plan["_mx_key"])
    unit = F.shiftrightunsigned(F.col("_mx_hash"), 11) / F.lit(float(2 ** 53))
    both = both.withColumn("_mx_bucket", F.floor(unit * F.col("_mx_buckets")))
    cut = _cuts(both)
    placed = both.join(F.broadcast(cut), "_mx_pattern", "left")
    edge = placed.where(F.col("_mx_bucket") == F.col("_mx_cut")).select(
        "_mx_pattern", "_mx_row", "_mx_id", "_mx_hash", "_mx_size", "_mx_left")
    fit = edge.groupBy("_mx_pattern").applyInPandas(_fill_bucket, "_mx_row long, _mx_extra long")
    full = (F.col("_mx_bucket") < F.col("_mx_cut")).cast("long")
    out = placed.join(fit, "_mx_row", "left")
    times = F.when(F.col("_mx_size") > 0, F.col("_mx_whole") + F.coalesce("_mx_extra", full, F.lit(0))).otherwise(0)
    return out.select("_mx_id", "_mx_hash", "_mx_members", F.col("_mx_size").alias("size"),
                      F.col("_mx_source_size").alias("source_size"), F.col("_mx_target").alias("target"),
                      (times * F.col("_mx_size")).cast("long").alias("taken"), times.cast("long").alias("repeats"))


def _cuts(both: DataFrame) -> DataFrame:
    """Per pattern the hash bucket in which its rest runs out, and what is left for it.
    Bucket sums are pre-aggregated; the running sum has one row per bucket."""
    from pyspark.sql import Window
    sums = both.groupBy("_mx_pattern", "_mx_rest", "_mx_bucket").agg(F.sum("_mx_size").alias("s"))
    before = F.coalesce(F.sum("s").over(Window.partitionBy("_mx_pattern").orderBy("_mx_bucket")
                                        .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (sums.withColumn("b", before)
            .where((F.col("b") <= F.col("_mx_rest")) & (F.col("b") + F.col("s") > F.col("_mx_rest")))
            .select("_mx_pattern", F.col("_mx_bucket").alias("_mx_cut"),
                    (F.col("_mx_rest") - F.col("b")).alias("_mx_left")))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    source_col: str = "source", **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as the mix reads it (0 to
    ``repeats`` times), with its own columns only. Rows that agree in id, text and
    source are indistinguishable: each gets their mean number of readings, rounded up."""
    chosen = (mix(docs, id_col, text_col, source_col, **options)
              .groupBy("_mx_hash", "_mx_id", "_mx_members")
              .agg(F.sum("repeats").alias("_mx_sum"), F.count(F.lit(1)).alias("_mx_rows")))
    seed = options.get("seed", 17)
    member = F.col(source_col)
    if not dict(docs.dtypes)[source_col].startswith("array"):
        member = F.array(member)
    left = docs.withColumn("_mx_h", F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))).withColumn(
        "_mx_m", F.array_sort(F.array_distinct(member)))
    chosen = chosen.where("_mx_sum > 0")
    hit = left.join(chosen, (left["_mx_h"] == chosen["_mx_hash"]) & left[id_col].eqNullSafe(chosen["_mx_id"])
                    & (left["_mx_m"] == chosen["_mx_members"]))
    times = F.ceil(F.col("_mx_sum") / F.col("_mx_rows"))
    return (hit.withColumn("_mx_t", F.explode(F.sequence(F.lit(1).cast("long"), times)))
            .select(*[hit[c] for c in docs.columns]))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select(
        F.col("_mx_id").alias("doc_id"), "size", "source_size", "target", "taken")
