"""Closed-form statistics as native Spark expressions (no Python UDF)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Two-sided 95 % normal quantile, norm.isf(0.025).
Z_95 = 1.959963984540054


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def div0(a: Column, b: Column) -> Column:
    """a / b, 0 when b is 0 (the zero-division rule of the metrics)."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def divnull(a: Column, b: Column) -> Column:
    """a / b, null when b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def binary_metrics(tn: Column, fp: Column, fn: Column, tp: Column) -> dict[str, Column]:
    """Accuracy, precision, recall, F1 and Cohen's kappa from the 2x2 cells."""
    n = tn + fp + fn + tp
    po = divnull(tp + tn, n)
    pe = divnull((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp), n * n)
    return {
        "accuracy": po,
        "precision": div0(tp, tp + fp),
        "recall": div0(tp, tp + fn),
        "f1": div0(2 * tp, 2 * tp + fp + fn),
        # pe = 1 (both raters constant and equal) leaves kappa undefined.
        "kappa": F.try_divide(po - pe, F.when(pe != 1.0, 1.0 - pe)),
    }


def _stirling_error(x: Column) -> Column:
    """ln x! - ((x + 1/2) ln x - x + ln(2 pi) / 2) for whole x >= 1: from the factorial
    below 16, from the Stirling series above (next term under 1e-16 there)."""
    d = x.cast("double")
    small = F.log(F.factorial(F.least(x, F.lit(15)).cast("int"))) - (d + 0.5) * F.log(d) + d - 0.5 * math.log(2 * math.pi)
    d2 = d * d
    series = (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680) / d2) / d2) / d2) / d
    return F.when(x < 16, small).otherwise(series)


def mcnemar_exact_p(b: Column | str, c: Column | str) -> Column:
    """Two-sided exact McNemar p = min(1, 2 * BinomCDF(k; n, 1/2)), k = min(b, c), n = b + c.

    The largest term, C(n, k) / 2^n, comes from its deviance and Stirling errors (no
    difference of large logarithms). Each term below it is i / (n - i + 1) times the last,
    i = k, k-1, ...; after j steps it is at most exp(-2 j^2 / n) of the first, so the
    terms after 8 sqrt(n) + 50 steps are below 1e-55 of the sum: adding min(k, that
    many) of them loses nothing in double precision, at every size.
    """
    b, c = col(b).cast("long"), col(c).cast("long")
    n, k = b + c, F.least(b, c)
    nd, kd = n.cast("double"), k.cast("double")
    off = (kd * 2 - nd) / nd
    deviance = kd * F.log1p(off) + (nd - kd) * F.log1p(-off)
    first = (-0.5 * F.log(2 * math.pi * kd * (nd - kd) / nd) - deviance
             + _stirling_error(n) - _stirling_error(k) - _stirling_error(n - k))
    first = F.when(k >= 1, first).otherwise(-nd * math.log(2.0))
    count = F.least(k, F.ceil(8 * F.sqrt(nd) + 50).cast("long"))
    steps = F.when(count >= 1, F.sequence(F.lit(0).cast("long"), count - 1)).otherwise(F.array().cast("array<bigint>"))

    def step(acc, j):
        term = acc["t"] * ((k - j).cast("double") / (n - k + j + 1).cast("double"))
        return F.struct(term.alias("t"), (acc["s"] + term).alias("s"))

    total = F.aggregate(steps, F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")), step)["s"]
    return F.least(F.lit(1.0), F.exp(F.lit(math.log(2.0)) + first + F.log(total)))


def significance_marker(p: Column | str) -> Column:
    p = col(p)
    return (F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*")
            .otherwise("n.s."))


def wilson_interval(k: Column | str, n: Column | str, z: float = Z_95) -> tuple[Column, Column]:
    """Wilson score interval for k successes in n trials."""
    k = col(k).cast("double")
    n = F.when(col(n) > 0, col(n).cast("double"))  # no trials -> null interval
    p = divnull(k, n)
    z2 = z * z
    denom = 1.0 + z2 / n
    center = (p + z2 / (2.0 * n)) / denom
    half = z * F.sqrt(p * (1.0 - p) / n + z2 / (4.0 * n * n)) / denom
    return center - half, center + half


def python_mcnemar_p(b: int, c: int) -> float:
    """Plain-Python exact p for brute-force tests."""
    n, k = b + c, min(b, c)
    s = sum(math.comb(n, i) for i in range(k + 1)) / (2 ** n)
    return min(1.0, 2.0 * s)
