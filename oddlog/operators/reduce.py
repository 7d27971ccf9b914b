"""Linear encodings of a feature column: truncated SVD and centred PCA."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, functions as F

# The covariance of this many features still fits one process. Wider columns take the SVD encoding.
MAX_WIDTH = 16_384


def _check_width(width: int) -> None:
    if width > MAX_WIDTH:
        raise ValueError(f"{width} features are too many for a linear encoding; limit is {MAX_WIDTH}")


def _numbers(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


class LinearEncoder:
    """Projection ``(x - mean) @ components`` as a column expression."""

    def __init__(self, mean: np.ndarray, components: np.ndarray):
        self.mean, self.components = mean, components

    def encoded(self, features: str = "features") -> Column:
        centred = F.zip_with(vector_to_array(features), _numbers(self.mean), lambda x, m: x - m)
        dots = [
            F.aggregate(F.zip_with(centred, _numbers(c), lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x)
            for c in self.components.T
        ]
        return F.array(*dots)

    def residual(self, features: str = "features") -> Column:
        """Euclidean norm of what the encoding cannot rebuild."""
        centred = F.zip_with(vector_to_array(features), _numbers(self.mean), lambda x, m: x - m)
        square = lambda a: F.aggregate(F.transform(a, lambda x: x * x), F.lit(0.0), lambda s, x: s + x)
        return F.sqrt(F.greatest(square(centred) - square(self.encoded(features)), F.lit(0.0)))

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        return df.withColumn(features, array_to_vector(self.encoded(features)))


def _oriented(components: np.ndarray) -> np.ndarray:
    """Sign fixed by the largest loading of every component."""
    top = np.abs(components).argmax(axis=0)
    return components * np.where(components[top, np.arange(components.shape[1])] < 0, -1.0, 1.0)


def fit_pca(df: DataFrame, k: int, features: str = "features") -> LinearEncoder:
    """Principal components; the covariance is summed on the executors."""
    from pyspark.ml.stat import Summarizer

    mean = df.agg(Summarizer.mean(F.col(features)).alias("m")).first().m.toArray()
    _check_width(len(mean))
    model = PCA(k=min(k, len(mean)), inputCol=features, outputCol="_pc").fit(df)
    return LinearEncoder(mean, _oriented(model.pc.toArray()))


def fit_svd(df: DataFrame, k: int, features: str = "features") -> LinearEncoder:
    """Right singular vectors of the uncentred matrix, for any width; rows stay in the JVM."""
    matrix = RowMatrix(MLUtils.convertVectorColumnsFromML(df.select(features), features))
    found = matrix.computeSVD(min(k, matrix.numCols()))
    components = np.array(found.V.toArray())
    return LinearEncoder(np.zeros(components.shape[0]), _oriented(components))
