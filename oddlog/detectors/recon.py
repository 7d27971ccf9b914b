"""Reconstruction error of an encoding: linear, or a trained autoencoder."""

from __future__ import annotations

from pyspark.sql import DataFrame

from oddlog.detectors.base import Fitted, clean
from oddlog.operators.autoencoder import NetworkEncoder, fit_autoencoder
from oddlog.operators.reduce import LinearEncoder, fit_pca


class ReconModel(Fitted):
    def __init__(self, encoder: LinearEncoder | NetworkEncoder, train: DataFrame):
        self.encoder = encoder
        super().__init__(self.score(train))

    def score(self, rows: DataFrame) -> DataFrame:
        rows = clean(rows).select("row_id", "features")
        if isinstance(self.encoder, NetworkEncoder):
            return self.encoder.errors(rows)
        return rows.select("row_id", self.encoder.residual().alias("score"))


class Reconstruction:
    """With ``hidden_neurons`` or ``epoch_num`` a network of these widths down to ``latent_dim``, trained as many steps;
    without, the principal components."""

    neighbours = 0

    def __init__(self, latent_dim: int = 2, epoch_num: int | None = None, hidden_neurons: list[int] | None = None):
        self.latent_dim, self.steps, self.hidden = latent_dim, epoch_num, hidden_neurons

    def fit(self, rows: DataFrame, shared=None) -> ReconModel:
        rows = clean(rows)
        if self.steps is None and self.hidden is None:
            return ReconModel(fit_pca(rows, self.latent_dim), rows)
        widths = [*(self.hidden or [16]), self.latent_dim]
        return ReconModel(fit_autoencoder(rows, widths, self.steps or 60), rows)
