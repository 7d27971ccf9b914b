"""Task metrics, recall, votes; all as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)


def _count(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("long")


def counts() -> list[Column]:
    """n_samples and n_anomalies of a ``label`` column."""
    return [F.count(F.lit(1)).alias("n_samples"), _count(F.col("label") == -1).alias("n_anomalies")]


def confusion(y: str = "y") -> list[Column]:
    """Confusion counts of ``label`` against ``y``; one class gives zeros."""
    hit, true = F.col("label") == -1, F.col(y) == 1
    return [
        _count(~hit & ~true).alias("tn"), _count(hit & ~true).alias("fp"),
        _count(~hit & true).alias("fn"), _count(hit & true).alias("tp"),
    ]


def with_measures(df: DataFrame, digits: int = 4) -> DataFrame:
    """Accuracy, precision, recall and F1 from tn, fp, fn, tp."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    measures = {
        "accuracy": _ratio(tp + tn, tn + fp + fn + tp),
        "precision": _ratio(tp, tp + fp),
        "recall": _ratio(tp, tp + fn),
        "f1_score": _ratio(2 * tp, 2 * tp + fp + fn),
    }
    return df.withColumns({k: F.round(v, digits) for k, v in measures.items()})


def spread(score: str = "score") -> list[Column]:
    return [F.avg(score).alias("score_mean"), F.min(score).alias("score_min"), F.max(score).alias("score_max")]


def anomaly_recall(y: str = "y") -> Column:
    """Share of true anomalies that are flagged, 0 without any."""
    tp = _count((F.col("label") == -1) & (F.col(y) == 1))
    return _ratio(tp, _count(F.col(y) == 1))


def label_sets(scores: DataFrame, cuts: dict[str, float], keep: tuple[str, ...] = ("row_id", "score")) -> DataFrame:
    """One labelled copy of the scores per named cut, from one scoring."""
    sets = F.array(*[
        F.struct(F.lit(name).alias("variant"), F.lit(float(cut)).alias("cut")) for name, cut in cuts.items()
    ])
    spread_out = scores.select(*keep, F.explode(sets).alias("s"))
    label = F.when(F.col("score") > F.col("s.cut"), F.lit(-1)).otherwise(F.lit(1)).cast("byte")
    return spread_out.select(*keep, F.col("s.variant").alias("variant"), label.alias("label"))


def vote(labels: DataFrame, n_models: int, threshold: float = 0.5, key: str = "row_id") -> DataFrame:
    """-1 where at least ``threshold`` of the models flag a row; ties flag."""
    hits = F.sum(F.when(F.col("label") == -1, 1).otherwise(0))
    voted = F.when(hits >= threshold * n_models, F.lit(-1)).otherwise(F.lit(1)).cast("byte")
    return labels.groupBy(key).agg(voted.alias("label"))


def vote_cuts(scorings: list[tuple[DataFrame, list[float]]], threshold: float = 0.5, key: str = "row_id") -> DataFrame:
    """Vote over scorings with several cuts each.

    A scoring's cuts are counted inside its row, so only one row per scoring
    is shuffled, and none with a single scoring.
    """
    n_models = sum(len(cuts) for _, cuts in scorings)
    counted = [
        df.select(key, sum((F.when(F.col("score") > c, 1).otherwise(0) for c in cuts), F.lit(0)).alias("hits"))
        for df, cuts in scorings
    ]
    together = counted[0]
    for other in counted[1:]:
        together = together.unionByName(other)
    if len(counted) > 1:
        together = together.groupBy(key).agg(F.sum("hits").alias("hits"))
    flag = F.when(F.col("hits") >= threshold * n_models, F.lit(-1)).otherwise(F.lit(1)).cast("byte")
    return together.select(key, flag.alias("label"))
