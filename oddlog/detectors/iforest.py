"""Isolation forest (Liu et al. 2008): trees on bounded samples, scores everywhere."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, Window

from oddlog.detectors.base import Fitted, clean
from oddlog.operators.nearest import to_matrix, unpacked, vector_width
from oddlog.session import spread

SAMPLE = 256
_UNIT = 1 << 53


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) decided by the hash of its arguments."""
    return F.pmod(F.xxhash64(*parts), F.lit(_UNIT)) / F.lit(float(_UNIT))


def mean_path(n) -> np.ndarray:
    """Average path length of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype="float64")
    many = np.maximum(n, 3.0)
    long = 2.0 * (np.log(many - 1.0) + 0.5772156649015329) - 2.0 * (many - 1.0) / many
    return np.where(n > 2, long, np.where(n == 2, 1.0, 0.0))


def draw(rows: DataFrame, n: int, trees: int, bootstrap: bool, seed: int, margin: float) -> DataFrame:
    """``(tree, row_id)``: the rows of every tree's sample, by hash order.

    A hash prefilter keeps little more than the wanted rows; with replacement
    the prefilter is a Poisson number of copies, of which the first ones in
    hash order are a uniform draw.
    """
    size = min(SAMPLE, n)
    rate = margin * size / n
    numbers = F.sequence(F.lit(0), F.lit(trees - 1))
    if bootstrap:
        total, term, steps = 0.0, math.exp(-rate), []
        for count in range(1, 200):
            total += term
            steps.append(F.lit(total))
            term *= rate / count
            if 1.0 - total < 1e-15:
                break
        levels = F.array(*steps)

        def copies(t: Column) -> Column:
            u = uniform(F.lit(seed), t, F.col("row_id"))
            count = F.size(F.filter(levels, lambda level: level <= u))
            entry = lambda c: F.struct(t.alias("tree"), c.alias("copy"))
            return F.when(count > 0, F.transform(F.sequence(F.lit(1), count), entry)).otherwise(F.array().cast("array<struct<tree:int,copy:int>>"))

        drawn = F.flatten(F.transform(numbers, copies))
    else:
        hit = F.filter(numbers, lambda t: uniform(F.lit(seed), t, F.col("row_id")) < rate)
        drawn = F.transform(hit, lambda t: F.struct(t.alias("tree"), F.lit(0).alias("copy")))
    picked = rows.select("row_id", F.explode(drawn).alias("d")).select("row_id", "d.tree", "d.copy")
    order = Window.partitionBy("tree").orderBy(F.xxhash64(F.lit(seed + 1), "tree", "row_id", "copy"), "row_id", "copy")
    return picked.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= size).select("tree", "row_id")


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int):
    """One tree as parallel node lists; a leaf has feature -1."""
    feature, cut, left, right, size = [], [], [], [], []
    waiting = [(np.arange(len(x)), 0, None, False)]
    while waiting:
        rows, depth, parent, is_right = waiting.pop()
        node = len(feature)
        if parent is not None:
            (right if is_right else left)[parent] = node
        feature.append(-1), cut.append(0.0), left.append(-1), right.append(-1), size.append(len(rows))
        if depth >= limit or len(rows) <= 1:
            continue
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        usable = np.nonzero(high > low)[0]
        if not len(usable):
            continue
        f = int(rng.choice(usable))
        at = rng.uniform(low[f], high[f])
        at = low[f] if at >= high[f] else at
        feature[node], cut[node] = f, float(at)
        below = x[rows, f] <= at
        waiting.append((rows[~below], depth + 1, node, True))
        waiting.append((rows[below], depth + 1, node, False))
    return feature, cut, left, right, size


class ForestModel(Fitted):
    def __init__(self, train: DataFrame, width: int, trees: list, sample: int):
        self.width, self.trees, self.sample = width, trees, sample
        super().__init__(self.score(train))

    def score(self, rows: DataFrame) -> DataFrame:
        width, trees, scale = self.width, self.trees, float(mean_path(self.sample)) or 1.0

        def walk(x: np.ndarray) -> np.ndarray:
            total = np.zeros(len(x))
            every = np.arange(len(x))
            for feature, cut, left, right, rest in trees:
                at = np.zeros(len(x), dtype="int64")
                depth = np.zeros(len(x))
                while True:
                    inner = feature[at] >= 0
                    if not inner.any():
                        break
                    below = x[every, np.maximum(feature[at], 0)] <= cut[at]
                    at = np.where(inner, np.where(below, left[at], right[at]), at)
                    depth += inner
                total += depth + rest[at]
            return total / len(trees)

        def scored(batches):
            for pdf in batches:
                for p in range(0, len(pdf), 2048):
                    part = pdf.iloc[p : p + 2048]
                    paths = walk(to_matrix(part.vi, part.vv, width))
                    yield pd.DataFrame({"row_id": part.id.to_numpy(), "score": 2.0 ** (-paths / scale)})

        return unpacked(spread(clean(rows)), "row_id", "features", width).mapInPandas(scored, "row_id long, score double")


class IForest:
    neighbours = 0

    def __init__(self, n_estimators: int = 100, bootstrap: bool = False, seed: int = 7):
        self.n_estimators, self.bootstrap, self.seed = n_estimators, bootstrap, seed

    def fit(self, rows: DataFrame, shared=None) -> ForestModel:
        rows = clean(rows)
        n, width, seed = rows.count(), vector_width(rows), self.seed
        sample = min(SAMPLE, n)
        limit = max(1, math.ceil(math.log2(max(sample, 2))))

        def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("id")
            tree = int(key[0])
            grown = _grow(to_matrix(pdf.vi, pdf.vv, width), np.random.default_rng([seed, tree]), limit)
            names = ("feature", "cut", "left", "right", "size")
            return pd.DataFrame({"tree": [tree], "n": [len(pdf)], **{k: [v] for k, v in zip(names, grown)}})

        fields = unpacked(rows, "row_id", "features", width)
        ids, margin = spread(rows.select("row_id")), 1.5
        while True:
            # A few hundred rows per tree, whatever the size of the data.
            picks = draw(ids, n, self.n_estimators, self.bootstrap, seed, margin)
            sampled = fields.join(F.broadcast(picks.withColumnRenamed("row_id", "id")), "id")
            grown = sampled.groupBy("tree").applyInPandas(
                build,
                "tree int, n int, feature array<int>, cut array<double>, left array<int>, right array<int>, size array<int>",
            ).collect()
            if len(grown) == self.n_estimators and all(t.n >= sample for t in grown):
                break
            margin *= 2
        trees = [
            (np.array(t.feature), np.array(t.cut), np.array(t.left), np.array(t.right), mean_path(t["size"]))
            for t in sorted(grown, key=lambda t: t.tree)
        ]
        return ForestModel(rows, width, trees, sample)
