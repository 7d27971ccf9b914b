"""Mean and sum of a vector column per group."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F, types as T

# Up to this width every entry is an aggregate of its own: fixed-width buffers
# stay in the hash aggregate, where vector buffers fall back to sorting.
FLAT_WIDTH = 128


def vector_mean(
    df: DataFrame, by: list[str], vector: str, width: int, weight: Column | None = None,
    total: bool = False, out: str | None = None,
) -> DataFrame:
    """``(by, out)``: mean (or sum) vector per group, optionally weighted.

    ``vector`` may be a vector or an array column.
    """
    out = out or vector
    listed = isinstance(df.schema[vector].dataType, T.ArrayType)
    if width > FLAT_WIDTH:
        if listed:
            df = df.withColumn(vector, array_to_vector(vector))
        pick = Summarizer.sum if total else Summarizer.mean
        args = (F.col(vector),) if weight is None else (F.col(vector), weight.cast("double"))
        return df.groupBy(*by).agg(pick(*args).alias(out))
    w = F.lit(1.0) if weight is None else weight.cast("double")
    flat = df.select(*by, (F.col(vector) if listed else vector_to_array(vector)).alias("_a"), w.alias("_w"))
    sums = [F.sum(F.get("_a", F.lit(i)) * F.col("_w")).alias(f"_s{i}") for i in range(width)]
    summed = flat.groupBy(*by).agg(*sums, F.sum("_w").alias("_n"))
    size = F.lit(1.0) if total else F.col("_n")
    return summed.select(*by, array_to_vector(F.array(*[F.col(f"_s{i}") / size for i in range(width)])).alias(out))
