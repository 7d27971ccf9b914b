"""Detectors on neighbour lists: k-distance, local outlier factor, score transfer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from oddlog.detectors.base import Fitted, Shared, clean
from oddlog.operators.nearest import graph, nearest


def distance_score(nn: Column, method: str = "largest") -> Column:
    """Largest, mean or median of the ordered neighbour distances."""
    dist = F.transform(nn, lambda e: e["dist"])
    count = F.size(dist)
    if method == "largest":
        return F.coalesce(F.try_element_at(dist, F.lit(-1)), F.lit(0.0))
    if method == "mean":
        return F.aggregate(dist, F.lit(0.0), lambda a, x: a + x) / F.greatest(count, F.lit(1))
    if method == "median":
        low = F.get(dist, F.floor((count - 1) / 2).cast("int"))
        high = F.get(dist, F.floor(count / 2).cast("int"))
        return F.coalesce((low + high) / 2, F.lit(0.0))
    raise ValueError(f"unknown method {method!r}")


class KnnModel(Fitted):
    def __init__(self, train: DataFrame, lists: DataFrame, k: int, method: str):
        self.train, self.k, self.method = train, k, method
        super().__init__(lists.select("row_id", distance_score(F.col("nn"), method).alias("score")))

    def score(self, rows: DataFrame) -> DataFrame:
        return self.score_lists(nearest(clean(rows), self.train, self.k))

    def score_lists(self, lists: DataFrame) -> DataFrame:
        """Scores of rows whose lists among the training rows are known, k long or longer."""
        return lists.select("row_id", distance_score(F.slice("nn", 1, self.k), self.method).alias("score"))


class KNN:
    def __init__(self, n_neighbors: int = 5, method: str = "largest", include_self: bool = False):
        self.k, self.method, self.include_self = n_neighbors, method, include_self
        self.neighbours = n_neighbors

    def fit(self, rows: DataFrame, shared: Shared | None = None) -> KnnModel:
        shared = shared or Shared(clean(rows))
        return KnnModel(shared.features, shared.lists(self.k, self.include_self), self.k, self.method)


def _reachability(edges: DataFrame, reach: DataFrame) -> DataFrame:
    """Local density: inverse mean reachability distance of a row."""
    met = edges.join(reach, "nbr_id").select("row_id", "nbr_id", F.greatest("dist", "reach").alias("reach"))
    return met.groupBy("row_id").agg((1.0 / (F.avg("reach") + 1e-10)).alias("lrd"))


def _outlier_factor(edges: DataFrame, own: DataFrame, others: DataFrame) -> DataFrame:
    around = edges.join(others.select(F.col("row_id").alias("nbr_id"), "lrd"), "nbr_id")
    around = around.groupBy("row_id").agg(F.avg("lrd").alias("around"))
    return around.join(own, "row_id").select("row_id", (F.col("around") / F.col("lrd")).alias("score"))


class LofModel(Fitted):
    def __init__(self, train: DataFrame, lists: DataFrame, k: int):
        self.train, self.k = train, k
        edges = graph(lists)
        self.reach = lists.select(
            F.col("row_id").alias("nbr_id"), distance_score(F.col("nn")).alias("reach")
        )
        self.lrd = _reachability(edges, self.reach)
        super().__init__(_outlier_factor(edges, self.lrd, self.lrd))

    def score(self, rows: DataFrame) -> DataFrame:
        return self.score_lists(nearest(clean(rows), self.train, self.k))

    def score_lists(self, lists: DataFrame) -> DataFrame:
        """As `KnnModel.score_lists`."""
        edges = graph(lists.select("row_id", F.slice("nn", 1, self.k).alias("nn")))
        return _outlier_factor(edges, _reachability(edges, self.reach), self.lrd)


class LOF:
    """Breunig et al. 2000."""

    def __init__(self, n_neighbors: int = 20, include_self: bool = False):
        self.k, self.include_self = n_neighbors, include_self
        self.neighbours = n_neighbors

    def fit(self, rows: DataFrame, shared: Shared | None = None) -> LofModel:
        shared = shared or Shared(clean(rows))
        return LofModel(shared.features, shared.lists(self.k, self.include_self), self.k)


def transfer_scores(rows: DataFrame, train: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """Score of new rows: inverse-distance mean over the k nearest scored rows."""
    edges = graph(nearest(rows, train, k))
    weight = 1.0 / (F.col("dist") + 1e-10)
    met = edges.join(scores.select(F.col("row_id").alias("nbr_id"), "score"), "nbr_id")
    return met.groupBy("row_id").agg((F.sum(weight * F.col("score")) / F.sum(weight)).alias("score"))
