"""Label evaluation as aggregates over a long prediction table.

Wide tables with one column per model are unpivoted to
``(id, model, label)`` so a single ``groupBy(model)`` scores any number of
models in one pass: partial aggregation on every task, a tiny final merge.
Nulls are dropped pairwise (a row counts for a model only when both the gold
and that model's label are present) and ``n_used`` is reported next to the
metrics.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textrisk.functions.stats import binary_metrics, divnull


def to_long(df: DataFrame, id_cols: Sequence[str], model_cols: Sequence[str],
            model_col: str = "model", label_col: str = "label") -> DataFrame:
    """C9 wide -> long: one row per (id, model)."""
    return df.unpivot(list(id_cols), list(model_cols), model_col, label_col)


def to_wide(df: DataFrame, id_cols: Sequence[str], models: Sequence[str],
            model_col: str = "model", label_col: str = "label") -> DataFrame:
    """C9 long -> wide; the model list is given so no extra pass finds it."""
    return df.groupBy(*id_cols).pivot(model_col, list(models)).agg(F.first(label_col))


def prevalence(long: DataFrame, group_cols: Sequence[str] = ("model",),
               label_col: str = "label") -> DataFrame:
    """Positives, labelled rows and the positive share per group."""
    lab = F.col(label_col)
    return (long.groupBy(*group_cols)
            .agg(F.count_if(lab == 1).alias("positives"), F.count(lab).alias("n"))
            .withColumn("share", divnull(F.col("positives"), F.col("n"))))


def label_distribution(long: DataFrame, group_cols: Sequence[str] = ("model",),
                       label_col: str = "label") -> DataFrame:
    """Counts and percentages of 1 and 0; nulls are out of the total."""
    lab = F.col(label_col)
    out = long.groupBy(*group_cols).agg(F.count_if(lab == 1).alias("risk"),
                                        F.count_if(lab == 0).alias("non_risk"))
    total = F.col("risk") + F.col("non_risk")
    return (out.withColumn("total", total)
            .withColumn("risk_pct", divnull(F.col("risk") * 100, total))
            .withColumn("non_risk_pct", divnull(F.col("non_risk") * 100, total)))


def confusion_counts(long: DataFrame, gold_col: str = "gold", pred_col: str = "label",
                     group_cols: Sequence[str] = ("model",)) -> DataFrame:
    """The 2x2 cells per group, labels fixed to {0, 1}."""
    g, p = F.col(gold_col), F.col(pred_col)
    return long.groupBy(*group_cols).agg(
        F.count_if((g == 0) & (p == 0)).alias("tn"), F.count_if((g == 0) & (p == 1)).alias("fp"),
        F.count_if((g == 1) & (p == 0)).alias("fn"), F.count_if((g == 1) & (p == 1)).alias("tp"))


def with_binary_metrics(conf: DataFrame) -> DataFrame:
    """D3 + binary D4 from the cells: accuracy, precision, recall, F1, kappa."""
    m = binary_metrics(F.col("tn"), F.col("fp"), F.col("fn"), F.col("tp"))
    out = conf.withColumn("n_used", F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp"))
    for k, v in m.items():
        out = out.withColumn(k, v)
    return out


def confusion_normalised(conf: DataFrame) -> DataFrame:
    """Cells as shares of their actual-class row."""
    neg, pos = F.col("tn") + F.col("fp"), F.col("fn") + F.col("tp")
    return (conf.withColumn("tn_share", divnull(F.col("tn"), neg))
            .withColumn("fp_share", divnull(F.col("fp"), neg))
            .withColumn("fn_share", divnull(F.col("fn"), pos))
            .withColumn("tp_share", divnull(F.col("tp"), pos)))


def metrics_table(wide: DataFrame, gold_col: str, models: Sequence[tuple[str, Column | str]],
                  constant_baseline: bool = True, id_cols: Sequence[str] = ()) -> DataFrame:
    """D8 (+ D5): one row per model in the given order.

    ``models`` holds (display name, column or expression). The all-positive
    baseline is just one more model, ``lit(1)``. Rows where gold or the
    prediction is null are dropped per model.
    """
    items = list(models) + ([("All positive", F.lit(1))] if constant_baseline else [])
    cols = [(F.col(c) if isinstance(c, str) else c).cast("int").alias(f"_m{i}")
            for i, (_, c) in enumerate(items)]
    wide2 = wide.select(*id_cols, F.col(gold_col).cast("int").alias("gold"), *cols)
    long = to_long(wide2, [*id_cols, "gold"], [f"_m{i}" for i in range(len(items))], "_mid", "label")
    long = long.where(F.col("gold").isNotNull() & F.col("label").isNotNull())
    conf = with_binary_metrics(confusion_counts(long, "gold", "label", ["_mid"]))
    names = wide.sparkSession.createDataFrame(
        [(f"_m{i}", i + 1, name) for i, (name, _) in enumerate(items)], "_mid string, ord int, model string")
    # Every model appears, also one without a usable row; both sides have one
    # row per model (a parameter list), so the cell table is broadcast.
    return (names.join(F.broadcast(conf), "_mid", "left")
            .select("ord", "model", *[F.coalesce(F.col(c), F.lit(0)).alias(c)
                                      for c in ("tn", "fp", "fn", "tp", "n_used")],
                    "accuracy", "precision", "recall", "f1", "kappa"))


def kappa_table(df: DataFrame, a_col: str, b_col: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """D4 for any number of classes: (po - pe) / (1 - pe), null when pe = 1.

    Rows are first reduced to the cell table (a, b, count) -- at most K^2
    rows per group -- and the marginals come from that table, never from rows.
    """
    g = list(group_cols)
    a, b = F.col(a_col), F.col(b_col)
    cells = (df.where(a.isNotNull() & b.isNotNull())
             .groupBy(*g, a.alias("_a"), b.alias("_b")).agg(F.count(F.lit(1)).alias("_c")))
    wg = Window.partitionBy(*g) if g else Window.partitionBy(F.lit(0))
    cells = cells.withColumn("_n", F.sum("_c").over(wg))
    ra = cells.groupBy(*g, F.col("_a").alias("_k")).agg(F.sum("_c").alias("_ra"))
    cb = cells.groupBy(*g, F.col("_b").alias("_k")).agg(F.sum("_c").alias("_cb"))
    pe = (ra.join(cb, [*g, "_k"], "inner").groupBy(*g)
          .agg(F.sum(F.col("_ra") * F.col("_cb")).alias("_pe_num")))
    po = cells.groupBy(*g).agg(F.sum(F.when(F.col("_a") == F.col("_b"), F.col("_c")).otherwise(0)).alias("_agree"),
                               F.first("_n").alias("n_used"))
    out = po.join(pe, g, "left") if g else po.crossJoin(pe)
    p_o = divnull(F.col("_agree"), F.col("n_used"))
    p_e = divnull(F.coalesce(F.col("_pe_num"), F.lit(0)), F.col("n_used") * F.col("n_used"))
    return out.select(*g, "n_used", p_o.alias("po"), p_e.alias("pe"),
                      F.try_divide(p_o - p_e, F.when(p_e != 1.0, 1.0 - p_e)).alias("kappa"))


def pairwise_agreement(wide: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """D13 + D14 for binary runs: per pair the rows where both are present,
    the share equal, the number changed, and kappa -- one pass for all pairs
    (four cell counts per pair), then one row per pair."""
    aggs = []
    for i, (a, b) in enumerate(pairs):
        x, y = F.col(a), F.col(b)
        for cell, cond in (("00", (x == 0) & (y == 0)), ("01", (x == 0) & (y == 1)),
                           ("10", (x == 1) & (y == 0)), ("11", (x == 1) & (y == 1))):
            aggs.append(F.count_if(cond).alias(f"p{i}_{cell}"))
    cells = wide.agg(*aggs)
    stack = ", ".join(f"{i + 1}, '{a}', '{b}', p{i}_00, p{i}_01, p{i}_10, p{i}_11"
                      for i, (a, b) in enumerate(pairs))
    rows = cells.select(F.expr(f"stack({len(pairs)}, {stack}) AS (pair_no, run_a, run_b, c00, c01, c10, c11)"))
    m = binary_metrics(F.col("c00"), F.col("c01"), F.col("c10"), F.col("c11"))
    n = F.col("c00") + F.col("c01") + F.col("c10") + F.col("c11")
    return rows.select("pair_no", "run_a", "run_b", n.alias("n_used"),
                       divnull(F.col("c00") + F.col("c11"), n).alias("agreement"),
                       (F.col("c01") + F.col("c10")).alias("n_changed"),
                       m["kappa"].alias("kappa"))


def mean_sd(long: DataFrame, group_cols: Sequence[str], value_col: str) -> DataFrame:
    """Mean and sample standard deviation (ddof = 1) per group."""
    v = F.col(value_col)
    return long.groupBy(*group_cols).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"),
                                         F.count(v).alias("n"))


__all__ = ["to_long", "to_wide", "prevalence", "label_distribution", "confusion_counts",
           "with_binary_metrics", "confusion_normalised", "metrics_table", "kappa_table",
           "pairwise_agreement", "mean_sd"]
