"""Writers (A2) and the append-only result store for scored rows (A4)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STORE_SCHEMA = T.StructType([
    T.StructField("row_id", T.LongType()),
    T.StructField("model", T.StringType()),
    T.StructField("run", T.IntegerType()),
    T.StructField("label", T.IntegerType()),
    T.StructField("response", T.StringType()),
    T.StructField("error", T.StringType()),
])


def sink(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """A2: overwrite a result table; the writer makes the folders."""
    w = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        w = w.option("header", True).option("escape", '"')
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def store_append(df: DataFrame, path: str) -> None:
    """A4: append one batch of scored rows, partitioned by (model, run).

    A task retry may write a row twice; readers de-duplicate (store_read).
    """
    (df.select(*[F.col(f.name).cast(f.dataType) for f in STORE_SCHEMA.fields])
       .write.mode("append").partitionBy("model", "run").parquet(path))


def store_read(spark: SparkSession, path: str) -> DataFrame:
    """Stored rows, one per (row_id, model, run); a labelled copy wins over a
    failed one. Missing store -> empty frame."""
    from textrisk.sources.readers import optional_source
    df = optional_source(spark, path, lambda p: spark.read.schema(STORE_SCHEMA).parquet(p))
    if df is None:
        return spark.createDataFrame([], STORE_SCHEMA)
    best = F.max_by(F.struct("label", "response", "error"), F.col("label").isNotNull().cast("int"))
    return (df.groupBy("row_id", "model", "run").agg(best.alias("_b"))
            .select("row_id", "model", "run", "_b.label", "_b.response", "_b.error"))
