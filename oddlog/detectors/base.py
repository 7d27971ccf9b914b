"""What every detector offers: fit, scores, cuts, labels, scores of new rows."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from oddlog.functions.rows import finite
from oddlog.operators.nearest import nearest
from oddlog.operators.quantile import quantiles
from oddlog.session import hold


def clean(df: DataFrame) -> DataFrame:
    """NaN and infinite entries become 0; rows without any stay as they are."""
    values = F.unwrap_udt(F.col("features"))["values"]
    bad = F.exists(values, lambda x: F.isnan(x) | x.isin(float("inf"), float("-inf")))
    repaired = array_to_vector(F.transform(vector_to_array("features"), finite))
    return df.select("row_id", F.when(bad, repaired).otherwise(F.col("features")).alias("features"))


def flag(score: Column, cut: float | Column) -> Column:
    """-1 above the cut, 1 otherwise."""
    return F.when(score > cut, F.lit(-1)).otherwise(F.lit(1)).cast("byte")


class Shared:
    """Work several detectors of one feature frame can share.

    One neighbour search at the largest k serves every smaller k.
    """

    def __init__(self, features: DataFrame, k: int = 0):
        self.features, self.k, self._lists = features, k, None

    def lists(self, k: int, include_self: bool = False) -> DataFrame:
        if include_self:
            return nearest(self.features, k=k, include_self=True)
        if self._lists is None or k > self.k:
            self.release()
            self.k = max(self.k, k)
            self._lists = hold(nearest(self.features, k=self.k))
        return self._lists.select("row_id", F.slice("nn", 1, k).alias("nn"))

    def release(self) -> None:
        if self._lists is not None:
            self._lists.unpersist()
            self._lists = None


class Fitted:
    """Scores of the training rows plus a way to score others."""

    # New rows are scored as members of one table with the training rows.
    scores_jointly = False

    def __init__(self, train_scores: DataFrame):
        self.train_scores = train_scores

    def score(self, rows: DataFrame) -> DataFrame:
        """``(row_id, score)`` of rows the model has not seen."""
        raise NotImplementedError

    def cuts(self, contamination: list[float]) -> dict[float, float]:
        """Score above which a row is anomalous, for all shares at once."""
        return cuts(self.train_scores, contamination)

    def labels(self, cut: float) -> DataFrame:
        """Training rows with their score and label."""
        return self.train_scores.withColumn("label", flag(F.col("score"), cut))

    def predict(self, rows: DataFrame, cut: float) -> DataFrame:
        return self.score(rows).withColumn("label", flag(F.col("score"), cut))


def cuts(scores: DataFrame, contamination: list[float]) -> dict[float, float]:
    """The (1 - c) quantile of the scores for every share c."""
    return dict(zip(contamination, quantiles(scores, "score", [1.0 - c for c in contamination])))
