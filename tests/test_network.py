"""Networks: gradients by differences, sums that no partitioning changes, encoders on a curve, far rows first."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from oddlog.detectors import LUNAR, Reconstruction
from oddlog.operators.autoencoder import fit_autoencoder
from oddlog.operators.network import ACTIVE, ERROR, LOSS_BITS, drawn, train


def rows_of(spark, x, y=None, parts=3):
    cells = [(v,) if y is None else (v, w) for v, w in zip(x, y or x)]
    return spark.createDataFrame(cells, "x array<double>" + ("" if y is None else ", y array<double>")).repartition(parts)


def vectors(spark, x, parts=3):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(x)], "row_id long, v array<double>").repartition(parts)
    return df.select("row_id", array_to_vector("v").alias("features"))


@pytest.mark.parametrize("loss, kind", [("logistic", "leaky"), ("square", "tanh")])
def test_gradient_against_differences(loss, kind):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 3))
    y = (rng.random((40, 1)) < 0.5).astype(float) if loss == "logistic" else x
    network = drawn([3, 5, y.shape[1]], 2, kind)
    whole = network.gradient(x, y, loss)
    flat, step = network.flat(), 1e-2
    cost = lambda n: n.gradient(x, y, loss)[0] / (1 << LOSS_BITS)
    for k in range(0, len(flat), 3):
        move = np.zeros(len(flat))
        move[k] = step
        want = (cost(network.moved(flat + move)) - cost(network.moved(flat - move))) / (2 * step)
        assert math.isclose(whole[1 + k] / (1 << (ACTIVE[0] + ERROR[0])), want, rel_tol=0.05, abs_tol=0.05)


def test_partitions_change_no_bit(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 4))
    y = (x[:, :1] + x[:, 1:2] ** 2 > 0.5).astype(float)
    starts = [drawn([4, 6, 1], s, "leaky") for s in range(2)]
    found = [train(rows_of(spark, x.tolist(), y.tolist(), parts), starts, "logistic", 6, 0.1).flat() for parts in (1, 8, 70)]
    assert (found[0] == found[1]).all() and (found[0] == found[2]).all()
    assert (found[0] != starts[0].flat()).any() and (found[0] != starts[1].flat()).any()


def test_network_follows_a_curve_that_no_line_does(spark):
    random.seed(3)
    at = [random.uniform(-1, 1) for _ in range(400)]
    curved = vectors(spark, [[t, t * t] for t in at])
    error = lambda model: model.train_scores.agg(F.avg(F.col("score") ** 2)).first()[0]
    linear = error(Reconstruction(latent_dim=1).fit(curved))
    bent = error(Reconstruction(latent_dim=1, epoch_num=110, hidden_neurons=[16]).fit(curved))
    assert bent < 0.5 * linear


def test_encoding_keeps_columns_and_width(spark):
    df = vectors(spark, np.random.default_rng(0).normal(size=(50, 6)).tolist()).withColumn("name", F.lit("a"))
    out = fit_autoencoder(df, [4, 2], 3).transform(df)
    assert set(out.columns) == {"row_id", "features", "name"} and out.count() == 50
    assert {len(r.features) for r in out.collect()} == {2}


@pytest.mark.parametrize("seed", range(7, 17))
def test_a_far_row_scores_highest(spark, seed):
    random.seed(1)
    x = [[random.gauss(0, 1), random.gauss(0, 5)] for _ in range(60)] + [[900.0, 40.0]]
    scores = dict(LUNAR(5, seed=seed, max_iter=6).fit(vectors(spark, x)).train_scores.collect())
    assert max(scores, key=scores.get) == 60


def test_copies_only(spark):
    scores = LUNAR(3, max_iter=2).fit(vectors(spark, [[1.0, 1.0]] * 9)).train_scores.collect()
    assert len(scores) == 9 and len({r.score for r in scores}) == 1
