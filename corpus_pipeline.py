"""Corpus pipeline: language ID, exact de-duplication, near-duplicate removal,
mixing to target weights, packing.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns
a DataFrame, which ``run`` writes as Parquet in the shared folder and reads back
as the next stage's ``docs``. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textrisk.llm.common import table, written
from textrisk.llm.exact_dedup import exact_dedup
from textrisk.llm.jaccard_join import jaccard_components
from textrisk.llm.langid import identify, train, with_letters
from textrisk.llm.mixing import mixed_documents
from textrisk.llm.packing import cut_pieces, pack


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found; those without a letter (und) go. Without
    any usable label the model has no language, and every text with a letter stays."""
    model = train(docs)
    if not model["langs"]:
        return with_letters(docs)
    return identify(docs, model).where(F.col("_lang.lang_pred") != "und").select(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased), the row with the largest doc_id stays."""
    return exact_dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by n-gram Jaccard, the one with the smallest doc_id stays."""
    parts = jaccard_components(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(
        F.col("doc_id").alias("_stays"))
    return docs.join(parts, docs["doc_id"].eqNullSafe(parts["_stays"]), "left_semi")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix reads it."""
    return mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequence and place in it."""
    return pack(cut_pieces(docs))


STAGES = [("language_id", language_id), ("exact_dedup", exact_copies), ("ngram_jaccard_join", near_copies),
          ("mix_sources", mix_sources), ("best_fit_packing", pack_sequences)]

# Model predictions, seeded selection and tokenisation are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
