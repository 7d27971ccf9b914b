"""Per-feature min-max scaling."""

from __future__ import annotations

from pyspark.ml.feature import ElementwiseProduct
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from oddlog.operators.tfidf import compressed


class MinMaxModel:
    """Fitted bounds; a constant feature maps to 0."""

    def __init__(self, low: list[float], high: list[float]):
        self.low, self.high = low, high

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        scale = [1.0 / (h - l) if h > l else 1.0 for l, h in zip(self.low, self.high)]
        if not any(self.low):
            # Counts start at 0, so scaling keeps the vectors sparse.
            product = ElementwiseProduct(scalingVec=Vectors.dense(scale), inputCol=features, outputCol="_s")
            return product.transform(df).drop(features).withColumnRenamed("_s", features)
        low = F.array(*[F.lit(float(x)) for x in self.low])
        by = F.array(*[F.lit(float(x)) for x in scale])
        shifted = F.zip_with(vector_to_array(features), low, lambda x, l: x - l)
        return compressed(df, F.zip_with(shifted, by, lambda x, s: x * s), features)


def fit_minmax(df: DataFrame, features: str = "features") -> MinMaxModel:
    """One aggregate; as many numbers as there are features reach the driver."""
    found = df.agg(Summarizer.min(F.col(features)).alias("lo"), Summarizer.max(F.col(features)).alias("hi")).first()
    return MinMaxModel(found.lo.toArray().tolist(), found.hi.toArray().tolist())


def minmax_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Scale plain numeric columns; one aggregate row joins back."""
    bounds = df.agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))]).first()
    for c in columns:
        lo, hi = bounds[f"{c}_lo"], bounds[f"{c}_hi"]
        span = hi - lo if lo is not None and hi > lo else None
        df = df.withColumn(c, (F.col(c) - lo) / span if span else F.lit(0.0))
    return df
