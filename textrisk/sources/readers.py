"""Readers for the published CSV tables, prompt files and the driver's Parquet
tables (operators A1, A3, A5)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


TEXT_COLUMNS = ("text", "html")


_SPREAD: dict[tuple, DataFrame] = {}

# Documented parameter: into how many parts a text table is dealt (round robin, no
# key, so a hot text does not matter) and written once before it is read. 0, the
# default, reads the files as they are; a caller whose source is one big split sets it.
TEXT_PARTITIONS = "spark.textrisk.textPartitions"


def table(spark: SparkSession, sf_dir: str, name: str, cols: Sequence[str] | None = None) -> DataFrame:
    """A driver table; selecting ``cols`` here makes the scan read only them."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    df = spark.read.parquet(path)
    parts = int(spark.conf.get(TEXT_PARTITIONS, "0"))
    if parts and any(c in df.columns for c in TEXT_COLUMNS):
        key = (spark.sparkContext.applicationId, path, source_stamp(spark, path), parts)
        if key not in _SPREAD:
            _SPREAD[key] = deal(df, parts)
        df = _SPREAD[key]
    return df.select(*cols) if cols else df


def source_stamp(spark: SparkSession, path: str) -> tuple:
    """What tells a rewritten table from the one read before, in any store that Spark reads: bytes,
    files and time of its folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    held = fs.getContentSummary(at)
    return held.getLength(), held.getFileCount(), fs.getFileStatus(at).getModificationTime()


def deal(df: DataFrame, parts: int) -> DataFrame:
    """``df`` dealt into ``parts`` parts, written once to the shared folder.

    Text cleaning and regex matching are CPU-bound row-wise work, and filters on the
    text move below a plain repartition into the scan task; from the written copy every
    later plan starts in ``parts`` tasks."""
    from textrisk.session import materialize
    return materialize(df.repartition(parts), "dealt")


def scan_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A1: a header CSV with an explicit schema; posts hold quotes and newlines."""
    return (spark.read.schema(schema)
            .option("header", True).option("multiLine", True)
            .option("escape", '"').option("mode", "PERMISSIVE")
            .csv(path))


def parse_list_column(c: str) -> F.Column:
    """A list stored as Python repr text, e.g. ``['risk', 'bias']``, to array<string>."""
    return F.from_json(F.replace(F.col(c), F.lit("'"), F.lit('"')), "array<string>")


def scan_templates(spark: SparkSession, path_glob: str) -> DataFrame:
    """A3: whole-file text with the file stem as name -> (name, template)."""
    df = spark.read.text(path_glob, wholetext=True)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1)
    return df.select(name.alias("name"), F.col("value").alias("template"))


def optional_source(spark: SparkSession, path: str, reader=None) -> DataFrame | None:
    """A5: None when the path does not exist, so callers can report and go on. Any other
    failure (corrupt files, access, schema) stays an error."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(conf).exists(at):
        return None
    return (reader or spark.read.parquet)(path)
