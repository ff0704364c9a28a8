"""Document fingerprints: bottom-k sketches of word-shingle hashes, in SQL functions.

A sketch is the sorted array of the ``K`` smallest distinct 64-bit hashes of a text's
five-word shingles (lower-cased A-Z; fewer words make one shingle). Sketches merge by
keeping the k smallest of their union, so parts of a text collection can be sketched
apart. From two sketches: resemblance (share of the union's k smallest that both have),
containment, and each one's distinct shingle count.

Defined results: null text is empty; an empty text has the empty sketch; two empty
sketches have resemblance 1, an empty and another one 0. Below k shingles all estimates
are exact. Rows with one doc_id and different texts follow one another in the order of
a hash of the text; rows that repeat both are one place in the order and get the same
result each; a null doc_id comes last. The next of a single document is itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textrisk.llm.common import SPACE, lower_ascii, table, written

K = 128
N = 5
HASH_RANGE = float(2 ** 64)


def word_hashes(text: Column) -> Column:
    """64-bit hash of each word of a lower-cased text; blank text gives []."""
    parts = F.split(F.regexp_replace(lower_ascii(text), f"^{SPACE}|{SPACE}$", ""), SPACE)
    return F.when(F.get(parts, F.lit(0)) == "", F.array().cast("array<bigint>")).otherwise(
        F.transform(parts, lambda w: F.xxhash64(w)))


def shingle_hashes(hashes: Column, n: int = N) -> Column:
    """Hashes of the n-word shingles from the array column of word hashes."""
    whole = F.transform(F.slice(hashes, 1, F.greatest(F.size(hashes) - (n - 1), F.lit(0))),
                        lambda h, i: F.xxhash64(h, *[F.get(hashes, i + j) for j in range(1, n)]))
    short = F.when(F.size(hashes) > 0, F.array(F.xxhash64(hashes))).otherwise(F.array().cast("array<bigint>"))
    return F.when(F.size(hashes) >= n, whole).otherwise(short)


def smallest(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def with_sketch(df: DataFrame, text: Column, name: str, n: int = N, k: int = K) -> DataFrame:
    """``df`` with the sketch of ``text`` in column ``name``; each step is a column of
    its own, so that no lambda computes the arrays again."""
    return (df.withColumn("_fp_words", word_hashes(text))
            .withColumn("_fp_shingles", shingle_hashes(F.col("_fp_words"), n))
            .withColumn(name, smallest(F.col("_fp_shingles"), k)).drop("_fp_words", "_fp_shingles"))


def merge(a: Column, b: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    union = merge(a, b, k)
    both = F.size(F.array_intersect(F.array_intersect(union, a), b))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.size(union)).cast("double")


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k."""
    last = (F.element_at(a, -1).cast("double") + HASH_RANGE / 2) / HASH_RANGE
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / last)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has."""
    union = merge(a, b, k)
    both = resemblance(a, b, k) * distinct_shingles(union, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_shingles(a, k)))


def as_text(a: Column) -> Column:
    """Hashes as hex, 16 characters each."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def successors(ids: DataFrame) -> DataFrame:
    """(doc, n, next): each key's successor in descending order, the first after the
    last. Keys are dealt into ranges and written once, so that the ranges stay fixed;
    a task orders one range, and only each range's first key is looked at globally.
    ``ids`` has the columns doc (unique) and n."""
    parts = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(ids.repartitionByRange(parts, F.col("doc").desc()).withColumn("part", F.spark_partition_id()),
                    "id-ranges")
    inside = dealt.withColumn("next", F.lead("doc").over(Window.partitionBy("part").orderBy(F.desc("doc"))))
    # One row per range.
    heads = dealt.groupBy("part").agg(F.max("doc").alias("head"))
    order = Window.orderBy("part")
    heads = heads.select("part", F.coalesce(F.lead("head").over(order),
                                            F.first("head").over(order)).alias("after"))
    return inside.join(F.broadcast(heads), "part").select("doc", "n", F.coalesce("next", "after").alias("next"))


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 n: int = N, k: int = K) -> DataFrame:
    """(id_col, text, sketch, next_sketch, edited): each text, the sketches of it and of
    the next document in descending order, and the text whose last third is replaced by
    the beginning of the next one. Only the needed beginnings and sketches travel."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    # The place in the order is the id; equal ids are told apart by their text's hash.
    key = F.struct(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"))
    rows = docs.select(key.alias("doc"), text.alias("_fp_text"))
    counts = rows.groupBy("doc").agg(F.max(F.char_length("_fp_text")).alias("n"))
    order = written(successors(counts), "successors")
    asked = order.select(F.col("next").alias("doc"), F.col("doc").alias("asker"), F.col("n").alias("asker_n"))
    # Both joins start from one exchange of the texts by their place; what travels on is
    # the beginning asked for and a sketch (made after the exchange: twice the work for
    # half the bytes).
    given = with_sketch(rows.join(asked, "doc"), F.col("_fp_text"), "sketch", n, k).select(
        F.col("asker").alias("doc"), F.col("sketch").alias("next_sketch"),
        F.substr("_fp_text", F.lit(1), F.floor(F.col("asker_n") / 3).cast("int")).alias("begin"))
    # A repeated row is one place: it gives one beginning.
    given = given.dropDuplicates(["doc"])
    both = with_sketch(rows.join(given, "doc"), F.col("_fp_text"), "sketch", n, k)
    chars = F.char_length("_fp_text")
    cut = (chars - F.floor(chars / 3)).cast("int")
    edited = F.concat(F.substr("_fp_text", F.lit(1), cut), F.col("begin"))
    return both.select(F.col("doc.id").alias(id_col), F.col("_fp_text").alias("text"), "sketch", "next_sketch",
                       edited.alias("edited"))


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_sketch(edited_pairs(table(spark, sf_dir, "documents")), F.col("edited"), "edited_sketch")
    return rows.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"))
