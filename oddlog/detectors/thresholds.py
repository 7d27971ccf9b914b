"""Cuts that replace the contamination share: functions of the scores alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from oddlog.operators.quantile import quantiles


def iqr(scores: DataFrame, column: str = "score") -> float:
    """Upper Tukey fence."""
    low, high = quantiles(scores, column, [0.25, 0.75])
    return high + 1.5 * (high - low)


def mad(scores: DataFrame, column: str = "score") -> float:
    """Median plus three scaled median absolute deviations."""
    (middle,) = quantiles(scores, column, [0.5])
    gaps = scores.select(F.abs(F.col(column) - middle).alias("gap"))
    (spread,) = quantiles(gaps, "gap", [0.5])
    return middle + 3.0 * 1.4826 * spread


def zscore(scores: DataFrame, column: str = "score") -> float:
    """Mean plus three standard deviations."""
    found = scores.agg(F.avg(column).alias("m"), F.stddev_pop(column).alias("s")).first()
    return found.m + 3.0 * found.s


THRESHOLDS = {"IQR": iqr, "MAD": mad, "ZSCORE": zscore}
