"""Incremental keyword screening with Structured Streaming.

New files arriving in a folder are screened with the same stages as the
batch job. The row-wise stages (null -> '', URL-only out, word count,
symbol strip, dash replacement, keyword match) run inside the streaming
plan; first-occurrence de-duplication needs what earlier batches saw, so it
runs in ``foreachBatch``: duplicates inside the batch collapse to the row
with the smallest order key (an aggregate with map-side combine), then an
anti-join against the table of raw-text hashes already kept removes texts
seen in earlier batches. "First" therefore means first batch, then smallest
key -- the file order of an append-only source.

Both outputs (candidates and seen hashes) are written per batch, to a folder
named by the batch id in overwrite mode, under the shared checkpoint folder; a
batch that is replayed after a failure reads the hashes of earlier batches only
and replaces its own folders, so no row is kept twice and none is lost.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textrisk.functions import text as TX
from textrisk.lexicons import KEYWORD_STEMS
from textrisk.operators import screen as S
from textrisk.session import checkpoint_dir
from textrisk.sources.readers import optional_source


def _row_stages(df: DataFrame, text_col: str) -> DataFrame:
    """Stateless stages; keeps a hash of the raw text as the de-dup key."""
    raw = TX.null_to_empty(text_col)
    return (df.withColumn(text_col, raw)
            .where(~TX.is_url_only(F.col(text_col)))
            .where(TX.has_min_words(F.col(text_col), 5))
            .withColumn("_raw_key", F.sha2(F.col(text_col), 256))
            .withColumn(text_col, TX.dashes_to_space(TX.strip_symbols(F.col(text_col)))))


def screen_stream(spark: SparkSession, source: str, schema: T.StructType, text_col: str,
                  order_col: str, out_dir: str | None = None, stems: Sequence[str] = KEYWORD_STEMS,
                  name: str = "screen") -> tuple[str, str]:
    """Screen every file under ``source`` not yet processed, then stop
    (``availableNow``). Returns (candidates path, seen-hashes path)."""
    base = out_dir or os.path.join(checkpoint_dir(spark), f"stream-{name}")
    cand_path, seen_path = os.path.join(base, "candidates"), os.path.join(base, "seen")
    seen_schema = T.StructType([T.StructField("_raw_key", T.StringType()), T.StructField("batch", T.LongType())])

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        s = batch.sparkSession
        seen = optional_source(s, seen_path, s.read.schema(seen_schema).parquet)
        first = S.dedup_first(batch, ["_raw_key"], order_col)
        if seen is not None:
            first = first.join(seen.where(F.col("batch") < batch_id), "_raw_key", "left_anti")
        new = first.persist()
        try:
            (S.with_keyword_matches(new, text_col, stems).where(F.size("matched_keywords") > 0)
             .drop("_raw_key").withColumn("batch_id", F.lit(batch_id))
             .write.mode("overwrite").parquet(f"{cand_path}/batch={batch_id}"))
            new.select("_raw_key").write.mode("overwrite").parquet(f"{seen_path}/batch={batch_id}")
        finally:
            new.unpersist()

    reader = spark.readStream.schema(schema)
    if os.path.isfile(source):  # one file: watch its folder, keep files of that name
        reader = reader.option("pathGlobFilter", os.path.basename(source))
        source = os.path.dirname(source)
    stream = _row_stages(reader.parquet(source), text_col)
    q = (stream.writeStream.foreachBatch(per_batch)
         .option("checkpointLocation", os.path.join(base, "_checkpoint"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return cand_path, seen_path
