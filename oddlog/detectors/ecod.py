"""Empirical tail probabilities per feature (Li et al. 2022)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from oddlog.detectors.base import Fitted, clean
from oddlog.functions.rows import nonzeros
from oddlog.operators.ecdf import run_sums, shifted, sorted_runs
from oddlog.session import broadcast_if_small, hold

_PARTS = ("left", "right", "skew", "worst")


def _tail(count: Column, n: int) -> Column:
    """Tail term of a zero entry; 0 where a feature has none."""
    return F.when(F.col("zeros") > 0, -F.log(F.greatest(count + F.col("zeros"), F.lit(1)) / n)).otherwise(0.0)


def _contributions(rows: DataFrame, n: int) -> tuple[DataFrame, dict[str, float], int]:
    """Tail terms of every nonzero (feature, value), relative to a zero entry.

    Zeros are never stored: a row of zeros only scores the returned base, a
    nonzero entry adds its difference to that. Per-feature numbers stay a
    table; only their sums reach the driver.
    """
    runs = sorted_runs(nonzeros(rows), n)
    sums = run_sums(runs)
    lines, size = sums.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    stats = sums.groupBy("feature_id").agg(*[F.sum(c).alias(f"all_{c}") for c in ("weight", "neg", "total")])
    stats = stats.withColumn("mean", F.col("all_total") / n).withColumn("zeros", n - F.col("all_weight"))
    means = broadcast_if_small(stats.select("feature_id", "mean"), lines)
    # Second pass around the mean: the sign of the third moment is what counts.
    centred = runs.join(means, "feature_id").groupBy("feature_id").agg(
        F.sum(F.col("weight") * F.pow(F.col("value") - F.col("mean"), 3)).alias("m3")
    )
    per_feature = hold(
        stats.join(centred, "feature_id")
        .withColumn("falls", F.col("m3") - F.col("zeros") * F.pow("mean", F.lit(3)) < 0)
        .withColumn("left0", _tail(F.col("all_neg"), n))
        .withColumn("right0", _tail(F.col("all_weight") - F.col("all_neg"), n))
        .withColumn("skew0", F.when(F.col("falls"), F.col("left0")).otherwise(F.col("right0")))
        .withColumn("worst0", F.greatest("left0", "right0"))
        .select("feature_id", "zeros", "falls", *[f"{p}0" for p in _PARTS])
    )
    row = per_feature.agg(*[F.coalesce(F.sum(f"{p}0"), F.lit(0.0)).alias(p) for p in _PARTS]).first()
    base = {p: float(row[p]) for p in _PARTS}
    at_most = F.col("upto") + F.when(F.col("value") > 0, F.col("zeros")).otherwise(0)
    terms = (
        shifted(runs, sums, lines).join(broadcast_if_small(per_feature, lines), "feature_id")
        .withColumn("left", -F.log(at_most / n))
        .withColumn("right", -F.log((n - at_most + F.col("weight")) / n))
        .withColumn("skew", F.when(F.col("falls"), F.col("left")).otherwise(F.col("right")))
        .withColumn("worst", F.greatest("left", "right"))
        .select("feature_id", "value", *[(F.col(p) - F.col(f"{p}0")).alias(p) for p in _PARTS])
    )
    return terms, base, int(size)


def _scores(rows: DataFrame, terms: DataFrame, base: dict[str, float], size: int, per_feature: bool) -> DataFrame:
    lines = nonzeros(rows, keep_empty=True)
    found = lines.join(broadcast_if_small(terms, size), ["feature_id", "value"], "left")
    summed = found.groupBy("row_id").agg(*[F.sum(p).alias(p) for p in _PARTS])
    total = {p: F.coalesce(p, F.lit(0.0)) + base[p] for p in _PARTS}
    score = total["worst"] if per_feature else F.greatest(total["left"], total["right"], total["skew"])
    return summed.select("row_id", score.alias("score"))


class EcodModel(Fitted):
    scores_jointly = True

    def __init__(self, train: DataFrame, per_feature: bool):
        self.train, self.per_feature = train, per_feature
        super().__init__(_scores(train, *_contributions(train, train.count()), per_feature))

    def score(self, rows: DataFrame) -> DataFrame:
        """New rows join the sample they are compared with."""
        fresh = clean(rows)
        both = self.train.unionByName(fresh)
        return _scores(fresh, *_contributions(both, both.count()), self.per_feature)


class ECOD:
    """Score: the largest of the left, right and skew-chosen tail sums.

    ``per_feature`` takes the larger tail feature by feature before summing.
    """

    neighbours = 0

    def __init__(self, per_feature: bool = False):
        self.per_feature = per_feature

    def fit(self, rows: DataFrame, shared=None) -> EcodModel:
        return EcodModel(clean(rows), self.per_feature)
