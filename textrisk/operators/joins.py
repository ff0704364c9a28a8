"""Key joins that replace positional alignment (H1-H5)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assert_unique(df: DataFrame, key_cols: Sequence[str], what: str = "source") -> None:
    """Fail when a key occurs twice. One aggregate over the key columns only
    (narrow rows, map-side combine); stops at the first duplicate found."""
    dup = (df.groupBy(*key_cols).agg(F.count(F.lit(1)).alias("_n"))
           .where(F.col("_n") > 1).limit(1).collect())
    if dup:
        row = dup[0].asDict()
        raise ValueError(f"{what} key {list(key_cols)} is not unique, e.g. {row}")


def rehydrate(ids: DataFrame, source: DataFrame, id_col: str, cols: Sequence[str],
              check_unique: bool = True) -> DataFrame:
    """H1: put columns (text) back by id. A non-unique source key is an error,
    never a fan-out; ids without a source row keep nulls (see ``unmatched``)."""
    if check_unique:
        assert_unique(source.select(id_col), [id_col])
    return ids.join(source.select(id_col, *cols), id_col, "left")


def unmatched(ids: DataFrame, source: DataFrame, id_col: str) -> DataFrame:
    """Ids with no source row."""
    return ids.join(source.select(id_col), id_col, "left_anti")


def align(left: DataFrame, right: DataFrame, key_cols: Sequence[str]) -> DataFrame:
    """H2: attach columns by key instead of by position, 1:1 checked."""
    assert_unique(left.select(*key_cols), key_cols, "left")
    assert_unique(right.select(*key_cols), key_cols, "right")
    return left.join(right, list(key_cols), "inner")


def lookup(df: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """H3: dimension lookup; unknown keys keep nulls. ``dim`` must be a fixed,
    small table (names, codes), hence the broadcast."""
    return df.join(F.broadcast(dim), key, "left")


def cross_small(df: DataFrame, small: DataFrame) -> DataFrame:
    """H5: rows x a fixed-size settings table (models, variants, pairs, sizes)."""
    return df.crossJoin(F.broadcast(small))
