"""Learned score over neighbour distances (after Goodge et al. 2022).

Made-up rows are real ones moved by a few times the distance of their own farthest neighbour, so one far row does not
stretch what the others are compared with. Distances count by their logarithm in units of the median one. The network's
weights stay above zero: a row that is farther from all its neighbours never scores less. Training is one full-batch
step a pass, and neither its order nor the partitions change the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from oddlog.detectors.base import Fitted, Shared, clean
from oddlog.detectors.iforest import uniform
from oddlog.detectors.neighbours import distance_score
from oddlog.operators.nearest import nearest
from oddlog.operators.network import Network, _matrix, drawn, train
from oddlog.operators.quantile import quantiles
from oddlog.session import hold

# Moves in units of the farthest neighbour's distance: of all features, of a share of them.
WIDE, NARROW, SHARE = 2.0, 4.0, 0.3
STARTS = 3


def _inputs(nn: Column, k: int, unit: float) -> Column:
    """Exactly k ordered distances, as logarithms of units; short lists repeat their last one."""
    dist = F.transform(nn, lambda e: e["dist"])
    spare = F.array_repeat(distance_score(nn), F.lit(k) - F.size(dist))
    return F.transform(F.slice(F.concat(dist, spare), 1, k), lambda d: F.log1p(d / F.lit(unit)))


def negatives(rows: DataFrame, lists: DataFrame, unit: float, seed: int) -> DataFrame:
    """One made-up row per row: even ids moved in all features, odd ids in a share of them."""
    far = distance_score(F.col("nn"))
    reach = lists.select("row_id", F.when(far > 0, far).otherwise(F.lit(unit)).alias("reach"))
    x = vector_to_array("features")
    even = F.pmod("row_id", F.lit(2)) == 0
    root = F.sqrt(F.greatest(F.size(x) * F.when(even, 1.0).otherwise(SHARE), F.lit(1.0)))
    u = lambda j, salt: uniform(F.lit(seed + salt), F.col("row_id"), j)
    size = F.col("reach") * F.when(even, WIDE).otherwise(NARROW) * 3**0.5 / root
    moved = F.transform(x, lambda v, j: v + F.when(even | (u(j, 1) < SHARE), size * (2 * u(j, 2) - 1)).otherwise(0.0))
    return rows.join(reach, "row_id").select("row_id", array_to_vector(moved).alias("features"))


class LunarModel(Fitted):
    def __init__(self, train: DataFrame, lists: DataFrame, k: int, network: Network, unit: float):
        self.train, self.k, self.network, self.unit = train, k, network, unit
        super().__init__(self._of(lists))

    def _of(self, lists: DataFrame) -> DataFrame:
        network = self.network

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                z = network.output(_matrix(batch.column(1)))[:, 0] if batch.num_rows else np.zeros(0)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-z)))], ["row_id", "score"])

        kind = lists.schema["row_id"].dataType.simpleString()
        return lists.select("row_id", _inputs(F.col("nn"), self.k, self.unit).alias("x")).mapInArrow(read, f"row_id {kind}, score double")

    def score(self, rows: DataFrame) -> DataFrame:
        return self._of(nearest(clean(rows), self.train, self.k))

    def score_lists(self, lists: DataFrame) -> DataFrame:
        """Scores of rows whose lists among the training rows are known, k long or longer."""
        return self._of(lists.select("row_id", F.slice("nn", 1, self.k).alias("nn")))


class LUNAR:
    def __init__(self, n_neighbours: int = 5, seed: int = 7, hidden: int = 16, max_iter: int = 30):
        self.k, self.seed, self.hidden, self.max_iter = n_neighbours, seed, hidden, max_iter
        self.neighbours = n_neighbours

    def fit(self, rows: DataFrame, shared: Shared | None = None) -> LunarModel:
        shared = shared or Shared(clean(rows))
        rows, lists = shared.features, shared.lists(self.k)
        far = lists.select(distance_score(F.col("nn")).alias("far")).filter("far > 0")
        unit = quantiles(far, "far", [0.5])[0] if not far.isEmpty() else 1.0
        fake = nearest(negatives(rows, lists, unit, self.seed), rows, self.k)
        real = lists.select("nn", F.array(F.lit(0.0)).alias("y"))
        told = real.unionByName(fake.select("nn", F.array(F.lit(1.0)).alias("y")))
        told = hold(told.select(_inputs(F.col("nn"), self.k, unit).alias("x"), "y"))
        starts = [drawn([self.k, self.hidden, 1], self.seed + s, "leaky") for s in range(STARTS)]
        network = train(told, starts, "logistic", self.max_iter, 0.1, rising=True)
        told.unpersist()
        return LunarModel(rows, lists, self.k, network, unit)
