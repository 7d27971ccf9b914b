"""Nonlinear encoding of a feature column, trained to rebuild its rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from oddlog.operators.network import Network, train
from oddlog.operators.reduce import fit_pca
from oddlog.session import hold

SMALL = 0.25  # where tanh is still nearly linear


def _started(sizes: list[int], axes: np.ndarray, seed: int) -> Network:
    """Layers that pass the leading axes through and hold small random weights beside them."""
    rng = np.random.default_rng(seed)
    k = axes.shape[1]
    layers = []
    for at, (a, b) in enumerate(zip(sizes[:-1], sizes[1:])):
        w = rng.normal(size=(a, b)) * 0.3 / np.sqrt(a)
        if at == 0:
            w[:, :k] = axes * SMALL
        elif at == len(sizes) - 2:
            w *= 0.1
            w[:k] = axes.T / SMALL
        else:
            w[:k, :k] = np.eye(k)
        bias = rng.normal(size=b) * (0.5 if 0 < at < len(sizes) - 2 else 0.0)
        bias[:k] = 0.0
        layers.append((w, bias))
    return Network(layers, "tanh")


class NetworkEncoder:
    """Centred and scaled rows through a network; encodings are the activations of its narrowest layer."""

    def __init__(self, network: Network, mean: np.ndarray, spread: np.ndarray, middle: int):
        self.network, self.mean, self.spread, self.middle = network, mean, spread, middle

    def _mapped(self, value, kind: str) -> Callable[[Column], Column]:
        mean, spread = self.mean, self.spread

        def read(rows: pd.Series) -> pd.Series:
            made = value((np.stack(rows.to_numpy()) - mean) / spread) if len(rows) else []
            return pd.Series(list(made), dtype=object if kind.startswith("array") else "float64")

        return F.pandas_udf(read, kind)

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        network, middle = self.network, self.middle
        coded = self._mapped(lambda x: network.output(x, middle), "array<double>")
        return df.withColumn(features, array_to_vector(coded(vector_to_array(features))))

    def errors(self, df: DataFrame, features: str = "features") -> DataFrame:
        """Columns beside the features, and the distance between each row and what the network rebuilds, as `score`."""
        network, spread = self.network, self.spread
        gap = self._mapped(lambda x: np.sqrt((((network.output(x) - x) * spread) ** 2).sum(1)), "double")
        return df.withColumn("score", gap(vector_to_array(features))).drop(features)


def fit_autoencoder(
    df: DataFrame, hidden: list[int], steps: int = 60, rate: float = 0.03, seed: int = 7, features: str = "features"
) -> NetworkEncoder:
    """Layers of the widths `hidden` down to the last and back; it starts from the principal components."""
    found = df.agg(Summarizer.mean(F.col(features)).alias("m"), Summarizer.std(F.col(features)).alias("s")).first()
    mean, spread = found.m.toArray(), found.s.toArray()
    # One unit for all features, so that the leading axes stay those of the rows.
    spread = np.full(len(mean), spread.max(initial=0.0) or 1.0)
    scaled = F.transform(
        F.arrays_zip(vector_to_array(features).alias("x"), F.array(*map(F.lit, mean.tolist())).alias("m"), F.array(*map(F.lit, spread.tolist())).alias("s")),
        lambda e: (e["x"] - e["m"]) / e["s"],
    )
    rows = hold(df.select(scaled.alias("x")))
    width = len(mean)
    axes = fit_pca(rows.select(array_to_vector("x").alias("features")), min(min(hidden), width)).components
    sizes = [width, *hidden, *reversed(hidden[:-1]), width]
    network = train(rows, [_started(sizes, axes, seed)], "square", steps, rate)
    rows.unpersist()
    return NetworkEncoder(network, mean, spread, len(hidden))
