"""Empirical tail counts per feature, spread over range partitions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from oddlog.session import broadcast_if_small, freeze, hold

WINDOW_ROWS = 500_000


def _running(batches):
    """Running weight per feature inside one sorted partition."""
    feature, carried = None, 0
    for pdf in batches:
        if pdf.empty:
            continue
        upto = pdf.groupby("feature_id")["weight"].cumsum()
        if feature is not None:
            upto = upto + carried * (pdf["feature_id"] == feature)
        feature, carried = pdf["feature_id"].iloc[-1], int(upto.iloc[-1])
        yield pdf.assign(upto=upto.astype("int64"))


def sorted_runs(long: DataFrame, n_rows: int | None = None) -> DataFrame:
    """``(feature_id, value, weight, _part, upto)``, computed once.

    Values are counted first, so copies collapse before the sort. A feature
    may span many partitions; ``upto`` runs inside one. With at most
    ``WINDOW_ROWS`` rows a feature fits one window group and needs no ranges.
    """
    keys = ["feature_id", "value"]
    counted = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("weight"))
    if n_rows is not None and n_rows <= WINDOW_ROWS:
        upto = F.sum("weight").over(Window.partitionBy("feature_id").orderBy("value"))
        return hold(counted.withColumn("_part", F.lit(0)).withColumn("upto", upto))
    return freeze(
        counted.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_part", F.spark_partition_id())
        .mapInPandas(_running, "feature_id int, value double, weight long, _part int, upto long")
    )


def run_sums(runs: DataFrame) -> DataFrame:
    """Sums per feature and partition: one line per feature and per partition edge.

    ``shift`` is the weight of a feature in the partitions before.
    """
    value, weight = F.col("value"), F.col("weight")
    sums = runs.groupBy("feature_id", "_part").agg(
        F.count(F.lit(1)).alias("size"),
        F.sum("weight").alias("weight"),
        F.sum(F.when(value < 0, weight).otherwise(0)).alias("neg"),
        F.sum(value * weight).alias("total"),
    )
    before = Window.partitionBy("feature_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return hold(sums.withColumn("shift", F.coalesce(F.sum("weight").over(before), F.lit(0))))


def tail_counts(long: DataFrame) -> DataFrame:
    """``(feature_id, value, weight, upto)``: rows equal to and at most a value."""
    runs = sorted_runs(long)
    sums = run_sums(runs)
    return shifted(runs, sums, sums.count())


def shifted(runs: DataFrame, sums: DataFrame, lines: int) -> DataFrame:
    """Running weights over whole features; ``lines`` is the size of ``sums``."""
    shifts = broadcast_if_small(sums.select("feature_id", "_part", "shift"), lines)
    return (
        runs.join(shifts, ["feature_id", "_part"])
        .withColumn("upto", F.col("upto") + F.col("shift"))
        .drop("_part", "shift")
    )
