"""TF-IDF weights, on sparse vectors and in long form."""

from __future__ import annotations

import math

from pyspark.ml.feature import ElementwiseProduct, Normalizer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window, functions as F


def _check_norm(norm: str | None) -> str | None:
    norm = None if norm is None or norm.lower() == "none" else norm.lower()
    if norm not in (None, "l1", "l2"):
        raise ValueError(f"unknown norm {norm!r}")
    return norm


def idf_value(df_count: float, n_docs: int, smooth: bool = True) -> float:
    return math.log((n_docs + smooth) / (df_count + smooth)) + 1.0


def idf_column(df_count: Column, n_docs: int, smooth: bool = True) -> Column:
    shift = 1.0 if smooth else 0.0
    return F.log((F.lit(float(n_docs)) + shift) / (df_count + shift)) + 1.0


def compressed(df: DataFrame, column: Column, out: str) -> DataFrame:
    """Array column to the smaller of the sparse and dense vector forms."""
    raw = df.withColumn("_raw", array_to_vector(column)).drop(out)
    return VectorAssembler(inputCols=["_raw"], outputCol=out).transform(raw).drop("_raw")


def tfidf_vectors(
    df: DataFrame,
    idf: list[float] | None,
    norm: str | None = "l2",
    sublinear_tf: bool = False,
    features: str = "features",
) -> DataFrame:
    """Weight a count-vector column in place; row-local and sparse throughout."""
    norm = _check_norm(norm)
    if sublinear_tf:
        damped = F.transform(vector_to_array(features), lambda x: F.when(x > 0, F.log(x) + 1.0).otherwise(0.0))
        df = compressed(df, damped, features)
    if idf is not None:
        scaled = ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol=features, outputCol="_w")
        df = scaled.transform(df).drop(features).withColumnRenamed("_w", features)
    if norm is not None:
        scaled = Normalizer(p=1.0 if norm == "l1" else 2.0, inputCol=features, outputCol="_w")
        df = scaled.transform(df).drop(features).withColumnRenamed("_w", features)
    return df


def tfidf_long(
    counts: DataFrame,
    vocab: DataFrame,
    n_docs: int,
    norm: str | None = "l2",
    use_idf: bool = True,
    smooth_idf: bool = True,
    sublinear_tf: bool = False,
    key: str = "row_id",
) -> DataFrame:
    """Weights ``(key, term, value)`` from ``(key, term, tf)`` and ``(term, df)``."""
    norm = _check_norm(norm)
    tf = F.log(F.col("tf")) + 1.0 if sublinear_tf else F.col("tf").cast("double")
    weight = tf * idf_column(F.col("df"), n_docs, smooth_idf) if use_idf else tf
    rows = counts.join(vocab.select("term", "df"), "term").select(key, "term", weight.alias("value"))
    if norm is None:
        return rows
    per_row = Window.partitionBy(key)
    size = F.sum("value").over(per_row) if norm == "l1" else F.sqrt(F.sum(F.col("value") * F.col("value")).over(per_row))
    return rows.select(key, "term", (F.col("value") / size).alias("value"))
