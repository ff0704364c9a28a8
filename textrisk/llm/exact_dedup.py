"""Exact de-duplication by skew-safe combining.

1. Each scan task combines its own copies: the partial aggregate of a grouping
   by (digest, salt, whole text), where the salt is the number of the task.
2. The salted digest groups are merged: one task sees at most one row of a text
   per scan task, and a text that fills the table is spread over ``salts`` keys.
3. The salt winners (at most ``salts`` rows for one text) are combined by
   (digest, whole text).

Whole texts are grouping keys in all three steps, so equal digests of different
texts never merge. Members then find their class by digest alone; texts that
share a digest with another text (none, for SHA-256) are joined by whole text.

Defined results: a null text is the empty text. A null doc_id is smaller than
any other. Rows that repeat both doc_id and text count in group_size, and
exactly one of them stays. Empty tables give empty results. Other columns may
have any name that does not start with ``_xd``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textrisk.llm.common import lower_ascii, written

SALTS = 64


def sha256_bytes(c: Column) -> Column:
    return F.unhex(F.sha2(c, 256))


def _keyed(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    return (docs.select(F.col(id_col).alias("_xd_id"), lower_ascii(F.col(text_col)).alias("_xd_text"))
            .withColumn("_xd_digest", digest(F.col("_xd_text"))))


def _combine(keyed: DataFrame, salts: int) -> DataFrame:
    """One row per distinct (digest, text): largest id and number of rows."""
    keys = ["_xd_digest", "_xd_text"]
    salted = (keyed.withColumn("_xd_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
              .groupBy("_xd_salt", *keys)
              .agg(F.max("_xd_id").alias("_xd_keep"), F.count(F.lit(1)).alias("_xd_n")))
    return (salted.repartition("_xd_digest").groupBy(*keys)
            .agg(F.max("_xd_keep").alias("_xd_keep"), F.sum("_xd_n").alias("_xd_n")))


def dedup_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  salts: int = SALTS, digest: Callable[[Column], Column] = sha256_bytes) -> DataFrame:
    """One row per row of ``docs``: (id_col, keep_id, group_size, kept, digest).

    ``digest`` only routes rows; a weak one costs time, never rightness.
    """
    keyed = _keyed(docs, id_col, text_col, digest)
    by_digest = written(_combine(keyed, salts).groupBy("_xd_digest").agg(
        F.count(F.lit(1)).alias("_xd_texts"), F.max("_xd_keep").alias("_xd_keep"),
        F.max("_xd_n").alias("_xd_n")), "dedup-winners")
    found = (keyed.groupBy("_xd_digest", "_xd_id").agg(F.count(F.lit(1)).alias("_xd_same"))
             .join(by_digest.where("_xd_texts = 1").drop("_xd_texts"), "_xd_digest"))
    shared = by_digest.where("_xd_texts > 1").select("_xd_digest")
    if not shared.isEmpty():
        mixed = keyed.join(shared, "_xd_digest", "left_semi")
        found = found.unionByName(
            mixed.groupBy("_xd_digest", "_xd_text", "_xd_id").agg(F.count(F.lit(1)).alias("_xd_same"))
            .join(_combine(mixed, salts), ["_xd_digest", "_xd_text"]).drop("_xd_text"))
    # A row repeated with the same id is one entry so far: give every row back.
    found = found.withColumn("_xd_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_xd_same"))))
    return found.select(
        F.col("_xd_id").alias(id_col), F.col("_xd_keep").alias("keep_id"),
        F.col("_xd_n").cast("long").alias("group_size"),
        (F.col("_xd_id").eqNullSafe(F.col("_xd_keep")) & (F.col("_xd_copy") == 1)).alias("kept"),
        F.col("_xd_digest").alias("digest"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                salts: int = SALTS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Digest and id are one key, never null, so the
    join and the choice among repeated rows share one move of the texts."""
    stay = (dedup_classes(docs, id_col, text_col, salts).where("kept")
            .select(F.struct(F.col("digest").alias("d"), F.col(id_col).alias("i")).alias("_xd_key")))
    tagged = docs.withColumn("_xd_key", F.struct(sha256_bytes(lower_ascii(F.col(text_col))).alias("d"), F.col(id_col).alias("i")))
    return tagged.join(stay, "_xd_key", "left_semi").dropDuplicates(["_xd_key"]).drop("_xd_key").select(*docs.columns)
