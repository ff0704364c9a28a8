"""Row numbers within groups without putting a whole group into one task.

``row_number() OVER (PARTITION BY g ORDER BY o)`` sends every row of a group
to one task; with a hot group (a third of the table) that task holds a third
of the data. ``rank_within`` gets the same numbers from a range-partitioned
sort: rows are spread over many tasks by (g, o), each task numbers its own
run of rows, and per-task counts (one row per task and group) give the
offsets. Work per task is bounded by the range partition size, not by the
group size. The numbered rows are written once: range bounds are sampled, so
counts and rows must come from one and the same dealing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textrisk.session import materialize


def rank_within(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str],
                rank_col: str = "rank", num_partitions: int | None = None) -> DataFrame:
    """Add a 1-based ``rank_col`` = position of the row inside its group.

    ``order_cols`` must order the rows of a group totally (append a unique key),
    otherwise the numbering of ties is not repeatable after a task retry.
    """
    keys = list(group_cols) + list(order_cols)
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(df.repartitionByRange(n, *keys)
                         .sortWithinPartitions(*keys)
                         .withColumn("_pid", F.spark_partition_id())
                         .withColumn("_mid", F.monotonically_increasing_id()))
    # One row per (task, group): how many rows the task holds and its first id.
    stats = ranged.groupBy("_pid", *group_cols).agg(
        F.count(F.lit(1)).alias("_cnt"), F.min("_mid").alias("_first"))
    before = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(
        Window.unboundedPreceding, -1)
    stats = stats.withColumn("_offset", F.coalesce(F.sum("_cnt").over(before), F.lit(0)))
    st = stats.select(F.col("_pid").alias("_spid"), *[F.col(g).alias(f"_s_{g}") for g in group_cols],
                      "_offset", "_first")
    # Null-safe on the group columns: a null key is a group of its own.
    cond = [ranged["_pid"] == st["_spid"]] + [ranged[g].eqNullSafe(st[f"_s_{g}"]) for g in group_cols]
    out = ranged.join(st, cond, "inner")
    return (out.withColumn(rank_col, (F.col("_offset") + F.col("_mid") - F.col("_first") + 1).cast("long"))
            .drop("_pid", "_mid", "_offset", "_first", "_spid", *[f"_s_{g}" for g in group_cols]))


def next_in_group(df: DataFrame, group_cols: Sequence[str], rank_col: str,
                  value_cols: Sequence[str], prefix: str = "next_") -> DataFrame:
    """Attach the values of the following row (rank + 1) of the same group by an
    equi-join on (group, rank): a lag/lead that shuffles by rank, not by group."""
    nxt = df.select(*[F.col(g).alias(f"_n_{g}") for g in group_cols], (F.col(rank_col) - 1).alias("_n_rank"),
                    *[F.col(v).alias(prefix + v) for v in value_cols])
    cond = [df[rank_col] == nxt["_n_rank"]] + [df[g].eqNullSafe(nxt[f"_n_{g}"]) for g in group_cols]
    return df.join(nxt, cond, "left").drop("_n_rank", *[f"_n_{g}" for g in group_cols])
