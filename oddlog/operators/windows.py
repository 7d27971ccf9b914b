"""Fixed-count row windows: values, labels, expansion.

Rows are summed into panes, of as many rows as size and step have in common, before anything moves. Panes are dealt in
blocks as long as a window, and each window is the end of one block and the beginning of the next: a pane sends its sum
with all panes after it in the block to the window that starts there, and with all before it to the window that ends
there. So at most two rows a pane cross the network, whatever the overlap, and nothing is subtracted.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from oddlog.operators.means import vector_mean
from oddlog.operators.nearest import vector_width

BIN_PANES = 1 << 16  # panes that one bin of blocks holds

# The default window.
WINDOW_DEFAULTS = {"size": 80, "method": "mean", "overlap": 0}


def window_count(n_rows: int, size: int, overlap: int) -> int:
    step = size - overlap
    if step <= 0:
        raise ValueError("overlap must be strictly less than size")
    return 0 if n_rows < size else (n_rows - size) // step + 1


def assign_windows(df: DataFrame, n_rows: int, size: int, overlap: int = 0, pos: str = "pos") -> DataFrame:
    """One row per (input row, covering window); rows of no window drop out."""
    step = size - overlap
    total = window_count(n_rows, size, overlap)
    first = F.greatest(F.lit(0), F.ceil((F.col(pos) - (size - 1)) / step)).cast("long")
    last = F.least(F.lit(total - 1), F.floor(F.col(pos) / step)).cast("long")
    # An empty range would make sequence() count downwards.
    return (
        df.withColumn("_first", first)
        .withColumn("_last", last)
        .filter("_first <= _last")
        .withColumn("win_id", F.explode(F.sequence("_first", "_last")))
        .drop("_first", "_last")
    )


def _halves(panes: DataFrame, by: list[str], per: int, hop: int, highest: bool) -> DataFrame:
    """(by, win_id, part): the one or two parts of every window, from panes (by, pane, part)."""
    schema = panes.schema
    kinds = ", ".join(f"`{c}` {schema[c].dataType.simpleString()}" for c in by)
    gather = np.maximum.accumulate if highest else np.cumsum

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        of = pdf["_block"].to_numpy()
        pdf = pdf.iloc[np.lexsort((pdf["pane"].to_numpy(), of))]
        of, pane = pdf["_block"].to_numpy(), pdf["pane"].to_numpy("int64")
        values = np.stack(pdf["part"].to_numpy())
        # Blocks of other groups may have one number by chance of the hash, so names are compared as well.
        turn = np.ones(len(pdf), bool)
        turn[1:] = of[1:] != of[:-1]
        for c in by:
            name = pdf[c].to_numpy()
            turn[1:] |= (name[1:] != name[:-1]) & ~(pd.isna(name[1:]) & pd.isna(name[:-1]))
        at = np.flatnonzero(turn)
        after, before = np.empty_like(values), np.empty_like(values)
        for low, high in zip(at, [*at[1:], len(pdf)]):
            before[low:high] = gather(values[low:high], axis=0)
            after[low:high] = gather(values[low:high][::-1], axis=0)[::-1]
        starts = pane % hop == 0
        first = pane - per + 1
        ends = (first % hop == 0) & (first >= 0) & (pane % per != per - 1)
        names = pdf[by]
        return pd.concat([
            names[starts].assign(win_id=pane[starts] // hop, part=pd.Series(list(after[starts]), index=names.index[starts], dtype=object)),
            names[ends].assign(win_id=first[ends] // hop, part=pd.Series(list(before[ends]), index=names.index[ends], dtype=object)),
        ])

    block = F.xxhash64(*by, F.floor(F.col("pane") / per))
    # Blocks, not panes, are dealt: a block is bounded by the window's size.
    bins = max(panes.sparkSession.sparkContext.defaultParallelism, panes.count() // BIN_PANES)
    dealt = panes.withColumn("_block", block).withColumn("_bin", F.pmod("_block", F.lit(bins)))
    return dealt.groupBy("_bin").applyInPandas(run, (kinds + ", " if kinds else "") + "win_id long, part array<double>")


def sliding(df: DataFrame, size: int, overlap: int, values: Column, width: int, by: list[str] = [], pos: str = "pos", highest: bool = False) -> DataFrame:
    """(by, win_id, part): sums (or maxima) of an array of `width` numbers over every whole window.

    ``pos`` counts rows from 0, inside each group of ``by`` if there is one.
    """
    step = size - overlap
    if step <= 0:
        raise ValueError("overlap must be strictly less than size")
    pane_rows = math.gcd(size, step)
    per, hop = size // pane_rows, step // pane_rows
    paned = df.select(*by, F.floor(F.col(pos) / pane_rows).alias("pane"), values.cast("array<double>").alias("part"))

    def combined(rows: DataFrame, keys: list[str]) -> DataFrame:
        if highest:
            return rows.groupBy(*keys).agg(F.array(*[F.max(F.get("part", F.lit(k))) for k in range(width)]).alias("part"))
        return vector_mean(rows, keys, "part", width, total=True).withColumn("part", vector_to_array("part"))

    panes = combined(paned, [*by, "pane"])
    if per == 1:
        return panes.filter(F.col("pane") % hop == 0).select(*by, (F.col("pane") / hop).cast("long").alias("win_id"), "part")
    return combined(_halves(panes, by, per, hop, highest), [*by, "win_id"])


def sliding_values(df: DataFrame, size: int, overlap: int, columns: list[str], method: str = "mean", by: list[str] = [], pos: str = "pos") -> DataFrame:
    """Mean (or sum) of plain numeric columns over every whole window; nulls do not count."""
    cells = [x for c in columns for x in (F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.col(c).isNotNull().cast("double"))]
    whole = sliding(df, size, overlap, F.array(*cells, F.lit(1.0)), 2 * len(columns) + 1, by, pos).filter(F.get("part", F.lit(2 * len(columns))) == size)
    total, count = (lambda k: F.get("part", F.lit(2 * k))), (lambda k: F.get("part", F.lit(2 * k + 1)))
    value = lambda k: F.when(count(k) > 0, total(k) if method == "sum" else total(k) / count(k))
    return whole.select(*by, "win_id", *[value(k).alias(c) for k, c in enumerate(columns)])


def sliding_features(df: DataFrame, size: int, overlap: int, method: str = "mean", features: str = "features", width: int | None = None, pos: str = "pos") -> DataFrame:
    """Mean (or sum) vector of every whole window."""
    width = vector_width(df, features) if width is None else width
    found = sliding(df, size, overlap, F.concat(vector_to_array(features), F.array(F.lit(1.0))), width + 1, pos=pos)
    whole = found.filter(F.get("part", F.lit(width)) == size)
    listed = F.slice("part", 1, width) if width else F.array().cast("array<double>")
    return whole.select("win_id", array_to_vector(listed if method == "sum" else F.transform(listed, lambda x: x / size)).alias("features"))


def sliding_labels(df: DataFrame, size: int, overlap: int, y: str = "y", pos: str = "pos") -> DataFrame:
    """A whole window is anomalous when any of its rows is."""
    kind = df.schema[y].dataType
    marked = sliding(df, size, overlap, F.array(F.coalesce(F.col(y).cast("double"), F.lit(-1.0)), F.col(pos)), 2, pos=pos, highest=True)
    # A window is whole when its last row is there.
    whole = marked.filter(F.get("part", F.lit(1)) == F.col("win_id") * (size - overlap) + size - 1)
    high = F.get("part", F.lit(0))
    return whole.select("win_id", F.when(high >= 0, high).cast(kind).alias(y))


def window_features(assigned: DataFrame, method: str = "mean", features: str = "features", width: int | None = None) -> DataFrame:
    """Mean (or sum) vector per window, summed up before the shuffle."""
    width = vector_width(assigned, features) if width is None else width
    return vector_mean(assigned, ["win_id"], features, width, total=method == "sum", out="features")


def window_values(assigned: DataFrame, columns: list[str], method: str = "mean") -> DataFrame:
    """Mean (or sum) per window of plain numeric columns."""
    reduce = F.sum if method == "sum" else F.avg
    return assigned.groupBy("win_id").agg(*[reduce(c).alias(c) for c in columns])


def window_labels(assigned: DataFrame, y: str = "y") -> DataFrame:
    """A window is anomalous when any of its rows is."""
    return assigned.groupBy("win_id").agg(F.max(y).alias(y))


def window_truth(y: Column, normal: str) -> Column:
    """Window truth as text: 'Anomaly' or the normal value."""
    return F.when(y == 1, F.lit("Anomaly")).otherwise(F.lit(normal))


def flagged_positions(
    labels: DataFrame, size: int, overlap: int = 0, pos: str = "pos", by: tuple[str, ...] = ()
) -> DataFrame:
    """Distinct positions covered by a window labelled -1, per label set ``by``.

    Only flagged windows are spread out, so the work follows them and not all
    windows.
    """
    start = F.col("win_id") * (size - overlap)
    return (
        labels.filter("label = -1")
        .select(*by, F.explode(F.sequence(start, start + (size - 1))).alias(pos))
        .distinct()
    )


def expand_to_rows(
    rows: DataFrame, labels: DataFrame, size: int, overlap: int = 0, pos: str = "pos"
) -> DataFrame:
    """Row flag -1 when a flagged window covers the row, 0 otherwise."""
    covered = flagged_positions(labels, size, overlap, pos).withColumn("_hit", F.lit(True))
    flag = F.when(F.col("_hit"), F.lit(-1)).otherwise(F.lit(0)).cast("byte")
    return rows.join(covered, pos, "left").withColumn("row_flag", flag).drop("_hit")
