"""Exact quantiles with linear interpolation, without one task holding the column."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from oddlog.session import hold

# Up to this many distinct values a single exact aggregate is fine.
DIRECT_VALUES = 1_000_000
_SPLITS = 64


def _rank_value(values: DataFrame, rank: int, distinct: int, direct: int) -> float:
    """Value at 0-based ``rank`` of the weighted table ``(value, weight)``.

    Each pass cuts the distinct values into splits, sums the weights below
    every split and keeps the one the rank falls in; ties never stall it
    because a value appears once.
    """
    low, high, below = None, None, 0
    while True:
        part = values
        if low is not None:
            part = part.filter(F.col("value") >= low)
        if high is not None:
            part = part.filter(F.col("value") < high)
        if distinct <= direct:
            # At most ``direct`` rows reach this one ordered pass.
            running = F.sum("weight").over(Window.orderBy("value"))
            reached = part.select("value", running.alias("upto")).filter(F.col("upto") > rank - below)
            return reached.agg(F.min("value")).first()[0]
        marks = part.agg(
            F.percentile_approx("value", [i / _SPLITS for i in range(1, _SPLITS)], 10_000)
        ).first()[0]
        marks = sorted(set(marks))
        sums = part.agg(
            *[F.sum(F.when(F.col("value") < m, F.col("weight")).otherwise(0)).alias(f"w{i}") for i, m in enumerate(marks)],
            *[F.sum(F.when(F.col("value") < m, 1).otherwise(0)).alias(f"d{i}") for i, m in enumerate(marks)],
        ).first()
        edges = [(low, 0, 0)] + [(m, sums[f"w{i}"], sums[f"d{i}"]) for i, m in enumerate(marks)]
        edges.append((high, None, distinct))
        for (lo, w, d), (hi, w_next, d_next) in zip(edges, edges[1:]):
            if w_next is None or below + w_next > rank:
                low, high, below, distinct = lo, hi, below + w, d_next - d
                break


def quantiles(df: DataFrame, column: str, shares: list[float], direct: int = DIRECT_VALUES) -> list[float]:
    """Quantiles of ``column`` at ``shares``, exact and linearly interpolated."""
    if not shares:
        return []
    rows = df.filter(F.col(column).isNotNull())
    n = rows.count()
    if n == 0:
        raise ValueError("no values to take a quantile of")
    if n <= direct:
        return list(rows.agg(F.percentile(column, [float(s) for s in shares])).first()[0])
    values = hold(rows.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("weight")))
    try:
        distinct = values.count()
        if distinct <= direct:
            found = values.agg(F.percentile("value", [float(s) for s in shares], F.col("weight"))).first()[0]
            return list(found)
        known: dict[int, float] = {}

        def at(rank: int) -> float:
            if rank not in known:
                known[rank] = _rank_value(values, rank, distinct, direct)
            return known[rank]

        result = []
        for share in shares:
            place = share * (n - 1)
            lo, hi = math.floor(place), math.ceil(place)
            result.append(at(lo) if lo == hi else (hi - place) * at(lo) + (place - lo) * at(hi))
        return result
    finally:
        values.unpersist()
