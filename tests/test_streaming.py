"""Incremental screening: duplicates across batches keep the first batch's row."""

import os

from textrisk.lexicons import TEST_LEXICON
from textrisk.streaming.screen_stream import screen_stream


def test_stream_dedups_across_batches(spark, tmp_path):
    src = str(tmp_path / "src")
    schema = "id long, text string"
    a = spark.createDataFrame([(1, "you are a stupid clown ok"), (2, "a perfectly calm sentence here"),
                               (3, "https://t.co/x")], schema)
    a.coalesce(1).write.parquet(os.path.join(src, "part=1"))
    out = str(tmp_path / "out")
    cand, _ = screen_stream(spark, src, a.schema, "text", "id", out, TEST_LEXICON)
    first = {r.id for r in spark.read.parquet(cand).collect()}
    assert first == {1}
    b = spark.createDataFrame([(4, "you are a stupid clown ok"), (5, "what an idiot move that was")], schema)
    b.coalesce(1).write.parquet(os.path.join(src, "part=2"))
    cand, _ = screen_stream(spark, src, a.schema, "text", "id", out, TEST_LEXICON)
    rows = spark.read.parquet(cand).collect()
    assert sorted(r.id for r in rows) == [1, 5]
    assert {r.id: r.matched_keywords for r in rows}[5] == ["idiot"]


def test_replay_after_a_failure_between_the_writes(spark, tmp_path, monkeypatch):
    """The batch fails after its candidates are written; the restarted stream replays it."""
    import pytest
    from pyspark.sql import readwriter

    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    df = spark.createDataFrame([(1, "you are a stupid clown ok"), (2, "what an idiot move that was")], "id long, text string")
    df.coalesce(1).write.parquet(os.path.join(src, "part=1"))
    real = readwriter.DataFrameWriter.parquet

    def failing(self, path, *a, **k):
        if "/seen/" in path:
            raise OSError("injected")
        return real(self, path, *a, **k)

    with monkeypatch.context() as m:
        m.setattr(readwriter.DataFrameWriter, "parquet", failing)
        with pytest.raises(Exception):
            screen_stream(spark, src, df.schema, "text", "id", out, TEST_LEXICON)
    cand, _ = screen_stream(spark, src, df.schema, "text", "id", out, TEST_LEXICON)
    assert sorted(r.id for r in spark.read.parquet(cand).collect()) == [1, 2]
