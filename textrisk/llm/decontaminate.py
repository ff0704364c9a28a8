r"""Benchmark decontamination by Wu-Manber multi-pattern search.

Words are runs of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after lower-casing A-Z. A test
string is a window of ``WINDOW`` consecutive words of a benchmark item (an item of fewer
words, but not none, is one window), written with one space before, between and after its
words; a text is written the same way, so a test string occurs in it exactly where the
words do.

The search looks at the last block of the place a test string could end at: the shift
table says how far no test string can end, and impossible positions are skipped. At shift
0 the bucket of that block's hash holds the test strings that end so (the first ``m`` bytes of
each, ``m`` the least length of their group); they are compared directly, so hash collisions
cost time only. Strings of very unequal length are searched in groups of their own, or one
short item would shorten all shifts.

The tables are broadcast in parts of about ``MAX_WINDOWS`` windows, dealt by item and run
of windows, however many the benchmark has: each part is one pass over the texts, and the
hits of all parts are united. The driver holds one part at a time.

Defined results: null or empty text has no words and no hits; a benchmark row without words
has no window; rows that share an item_id are one item; windows of a null item_id mark
words but count as no item; rows that repeat a document are judged each for itself; empty tables
give no hits or no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textrisk.llm.common import UPPER, table, worker_cache, written

WINDOW = 10
MAX_WINDOWS = 100_000
RUN = 512  # windows of one item that stay together in a part
LENGTHS = 4  # longest test string of a group against the shortest
SIGNS = 8  # about as many signs are equally likely at a place of a text
# Letters and digits stay, A-Z is lowered, all other ASCII is space.
KEPT = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(KEPT).split()


def spaced(found: list[bytes]) -> bytes:
    return b" %b " % b" ".join(found)


def windows(found: list[bytes], width: int = WINDOW) -> list[bytes]:
    n = min(width, len(found))
    return [spaced(found[i:i + n]) for i in range(len(found) - n + 1)] if n else []


class WuManber:
    """All places of any of ``strings`` in a text."""

    def __init__(self, strings: list[bytes]):
        self.groups = []
        rest = sorted(set(strings), key=len)
        while rest:
            m = len(rest[0])
            group = [s for s in rest if len(s) <= LENGTHS * m]
            rest = rest[len(group):]
            self.groups.append(self._tables(group, m))

    @staticmethod
    def _tables(group: list[bytes], m: int) -> tuple:
        # Long enough that most blocks of a text are in no test string.
        block = max(1, min(math.ceil(math.log(2 * m * len(group)) / math.log(SIGNS)), (m + 1) // 2))
        most = min(m - block + 1, 255)
        size = 1 << max(10, min(24, (8 * m * len(group)).bit_length()))
        shift, buckets = bytearray([most]) * size, {}
        for s in group:
            for end in range(max(block, m - most + 1), m + 1):
                at = hash(s[end - block:end]) & (size - 1)
                if m - end < shift[at]:
                    shift[at] = m - end
            lengths = buckets.setdefault(hash(s[m - block:m]) & (size - 1), {}).setdefault(s[:m], {})
            lengths.setdefault(len(s), set()).add(s)
        return m, block, size - 1, shift, buckets

    def find(self, text: bytes) -> list[tuple[int, bytes]]:
        """(position, string) of every occurrence."""
        out, n = [], len(text)
        for m, block, mask, shift, buckets in self.groups:
            end = m
            while end <= n:
                at = hash(text[end - block:end]) & mask
                skip = shift[at]
                if skip:
                    end += skip
                    continue
                start = end - m
                tests = buckets[at].get(text[start:end])
                if tests is not None:
                    for length, strings in tests.items():
                        s = text[start:start + length]
                        if s in strings:
                            out.append((start, s))
                end += 1
        return out


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint spans in order that cover what ``spans`` do."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def benchmark_windows(benchmark: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(window, item, run): the distinct windows of every item."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(w, i, k // RUN) for i, t in zip(f["i"], f["t"], strict=True)
                    for k, w in enumerate(windows(words(t), width))]
            yield pd.DataFrame(rows, columns=["window", "item", "run"])

    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("binary").alias("t"))
    return rows.mapInPandas(run, "window binary, item string, run int").groupBy("window", "item").agg(
        F.min("run").alias("run"))


HITS = "n_words long, spans array<struct<a:int,b:int>>, items array<string>"


def scan(texts: DataFrame, held, keep_all: bool) -> DataFrame:
    """The rows of ``texts`` (keys..., t) with the hits of one part: united spans of word
    numbers (end exclusive) and the items. Rows without hits stay if ``keep_all``."""
    keys = [c for c in texts.columns if c != "t"]
    name = uuid.uuid4().hex

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = worker_cache("decontaminate")
        if name not in cache:
            cache.clear()
            cache[name] = WuManber(list(held.value)), held.value
        search, owners = cache[name]
        for f in frames:
            n_words, spans, items = [], [], []
            for t in f["t"]:
                found = words(t)
                text = spaced(found)
                hits = search.find(text)
                n_words.append(len(found))
                if hits:
                    spaces = np.flatnonzero(np.frombuffer(text, dtype=np.uint8) == 32)
                    first = np.searchsorted(spaces, [a for a, _ in hits]).tolist()
                    spans.append([{"a": a, "b": b} for a, b in united(
                        [(a, a + s.count(b" ") - 1) for a, (_, s) in zip(first, hits, strict=True)])])
                    items.append(sorted(set().union(*(owners[s] for s in {s for _, s in hits}))))
                else:
                    spans.append([])
                    items.append([])
            out = f[keys].assign(n_words=n_words, spans=spans, items=items)
            yield out if keep_all else out[np.array([bool(s) for s in spans], dtype=bool)]

    types = ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in texts.schema.fields if x.name != "t")
    return texts.mapInPandas(run, f"{types}, {HITS}")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text", width: int = WINDOW,
                 max_windows: int = MAX_WINDOWS) -> DataFrame:
    """(id_col, n_words, spans, items): one row per row of ``docs`` with the disjoint spans of
    its words inside benchmark windows, and the items (sorted strings) they come from."""
    spark = docs.sparkSession
    found = written(benchmark_windows(benchmark, item_col, item_text_col, width), "benchmark-windows")
    parts = max(1, math.ceil(found.count() / max_windows))
    part = F.pmod(F.xxhash64(F.coalesce("item", F.lit("")), "run"), F.lit(parts))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t"))
    if parts > 1:  # equal rows have equal hits, so id and text name them
        texts = texts.withColumn("digest", F.sha2(F.coalesce("t", F.lit(b"")), 256))
    scans = []
    for k in range(parts):
        owners: dict[bytes, list[str]] = {}
        for w, i in found.where(part == k).select("window", "item").toPandas().itertuples(index=False):
            own = owners.setdefault(bytes(w), [])
            if i is not None:
                own.append(i)
        scans.append(scan(texts, spark.sparkContext.broadcast(owners), keep_all=k == 0))
    base = scans[0]
    if parts > 1:
        more = scans[1]
        for s in scans[2:]:
            more = more.unionByName(s)
        more = more.groupBy(F.col("id").alias("m_id"), F.col("digest").alias("m_digest")).agg(
            F.flatten(F.collect_set("spans")).alias("m_spans"), F.flatten(F.collect_set("items")).alias("m_items"))
        base = base.join(more, (F.col("digest") == F.col("m_digest")) & F.col("id").eqNullSafe(F.col("m_id")), "left")
        base = base.withColumn("spans", _united(F.concat("spans", F.coalesce("m_spans", F.array())))).withColumn(
            "items", F.array_sort(F.array_distinct(F.concat("items", F.coalesce("m_items", F.array())))))
    return base.select(F.col("id").alias(id_col), "n_words", "spans", "items")


def _united(spans):
    """``united`` for the few spans of the parts of one document."""
    @F.pandas_udf("array<struct<a:int,b:int>>")
    def one(rows: pd.Series) -> pd.Series:
        return rows.map(lambda r: [{"a": a, "b": b} for a, b in united([(s["a"], s["b"]) for s in r])])

    return one(spans)


def op11_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
                        (F.size("spans") > 0).alias("contaminated"))


_WORDS = (rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), "
          r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS w FROM (
          SELECT item_id, ws, least({WINDOW}, len(ws)) AS n,
                 unnest(range(1, len(ws) - least({WINDOW}, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
occ AS (SELECT k, n, i, array_to_string(ws[i:i + n - 1], ' ') AS w FROM (
          SELECT k, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(ws) >= n)),
found AS (SELECT DISTINCT k, item_id, i, n FROM occ JOIN win USING (n, w)),
hit AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS p FROM found) GROUP BY k),
items AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS item FROM found WHERE item_id IS NOT NULL) GROUP BY k)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (k) LEFT JOIN items USING (k)
"""
