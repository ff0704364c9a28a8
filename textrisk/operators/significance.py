"""Paired significance tests between models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textrisk.functions.stats import mcnemar_exact_p, significance_marker


def pairwise_discordance(wide: DataFrame, gold_col: str,
                         pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Both right / A only / B only / both wrong for every pair.

    One aggregate with four conditional counts per pair (no self-join, no
    per-pair pass), then ``stack`` turns the single row into one row per pair.
    Rows where gold or either prediction is null are left out of that pair.
    """
    g = F.col(gold_col)
    aggs = []
    for i, (a, b) in enumerate(pairs):
        ok = g.isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull()
        ra, rb = F.col(a) == g, F.col(b) == g
        aggs += [F.count_if(ok & ra & rb).alias(f"c{i}_both"), F.count_if(ok & ra & ~rb).alias(f"c{i}_a"),
                 F.count_if(ok & ~ra & rb).alias(f"c{i}_b"), F.count_if(ok & ~ra & ~rb).alias(f"c{i}_none")]
    one = wide.agg(*aggs)
    body = ", ".join(f"{i + 1}, '{a}', '{b}', c{i}_both, c{i}_a, c{i}_b, c{i}_none"
                     for i, (a, b) in enumerate(pairs))
    return one.select(F.expr(
        f"stack({len(pairs)}, {body}) AS (pair_no, model_a, model_b, both_correct, a_only_correct, "
        "b_only_correct, both_wrong)"))


def mcnemar_pairs(wide: DataFrame, gold_col: str, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Exact McNemar p per pair and its significance marker.

    The marker uses the unrounded p; round only when presenting.
    """
    d = pairwise_discordance(wide, gold_col, pairs)
    p = mcnemar_exact_p("a_only_correct", "b_only_correct")
    return d.withColumn("p_value", p).withColumn("sig", significance_marker("p_value"))
