"""Grid search over contiguous folds, scored by recall on anomalies."""

from __future__ import annotations

import json
import statistics
import time

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from oddlog.detectors.base import Shared, clean
from oddlog.operators.evaluate import anomaly_recall, label_sets
from oddlog.operators.nearest import nearest
from oddlog.session import hold

DEFAULT_FOLDS = 5


def fold_of(pos: Column, n_rows: int, folds: int) -> Column:
    """Contiguous folds whose sizes differ by one at most, larger ones first."""
    small, extra = divmod(n_rows, folds)
    edge = (small + 1) * extra
    early = F.floor(pos / (small + 1))
    late = extra + F.floor((pos - edge) / max(small, 1))
    return F.when(pos < edge, early).otherwise(late).cast("int")


def fold_scores(rows: DataFrame, truth: DataFrame, scorings: list, folds: int, neighbours: int = 0) -> list[dict]:
    """Recall, fit seconds per (setting, fold).

    ``rows``: row_id, fold, features. ``scorings``: (detector factory taking
    rows and shared work, {setting number: contamination or threshold
    function}) pairs; a detector is fitted once per fold and serves all its
    cuts. With ``neighbours``, the largest list a detector takes, a fold's
    training rows and test rows are each searched once for all detectors. A
    detector that scores new rows together with its training rows scores all
    rows once for all folds.
    """
    found, whole = [], {}
    for fold in range(folds):
        train = clean(rows.filter(F.col("fold") != fold))
        test = clean(rows.filter(F.col("fold") == fold))
        shared = Shared(train, neighbours)
        lists = hold(nearest(test, train, neighbours)) if neighbours else None
        for i, (fit, cuts_of) in enumerate(scorings):
            start = time.perf_counter()
            model = fit(train, shared)
            known = model.train_scores = hold(model.train_scores)  # cuts take several passes
            cuts = cuts_of(model)
            spent = time.perf_counter() - start
            if getattr(model, "scores_jointly", False):
                # Training and test rows together are all rows, whatever the fold.
                if i not in whole:
                    whole[i] = hold(fit(clean(rows), None).train_scores)
                scores = whole[i].join(test.select("row_id"), "row_id", "left_semi")
            elif lists is not None and hasattr(model, "score_lists"):
                scores = model.score_lists(lists)
            else:
                scores = model.score(test)
            judged = label_sets(scores, {str(n): c for n, c in cuts.items()}, ("row_id", "score"))
            recalls = judged.join(truth, "row_id").groupBy("variant").agg(anomaly_recall().alias("recall"))
            recalled = {r.variant: r.recall for r in recalls.collect()}
            found += [{"setting": n, "fold": fold, "recall": float(recalled.get(str(n), 0.0)), "fit": spent} for n in cuts]
            known.unpersist()
        shared.release()
        if lists is not None:
            lists.unpersist()
    for scores in whole.values():
        scores.unpersist()
    return found


def fit_times(found: list[dict]) -> dict[int, tuple[float, float]]:
    """Mean and deviation of the fit seconds per setting."""
    spent: dict[int, list[float]] = {}
    for f in found:
        spent.setdefault(f["setting"], []).append(f["fit"])
    return {i: (statistics.fmean(s), statistics.pstdev(s)) for i, s in spent.items()}


def ranked(spark: SparkSession, found: list[dict]) -> DataFrame:
    """Mean, deviation and rank per setting; rank ties share the lowest rank."""
    scores = spark.createDataFrame(
        [(f["setting"], f["fold"], f["recall"]) for f in found], "setting int, fold int, recall double"
    )
    means = scores.groupBy("setting").agg(
        F.avg("recall").alias("mean_test_score"), F.stddev_pop("recall").alias("std_test_score")
    )
    # One row per grid setting.
    rank = F.rank().over(Window.orderBy(F.desc("mean_test_score")))
    return means.withColumn("rank_test_score", rank)


def summary(ranks: list, settings: list, times: dict[int, tuple[float, float]]) -> dict:
    """Best setting (the first of equals) and the search table as JSON."""
    rows = sorted(ranks, key=lambda r: r.setting)
    best = min(rows, key=lambda r: (r.rank_test_score, r.setting))
    table = {
        "params": [dict(settings[r.setting].best_keys) for r in rows],
        "mean_test_score": [r.mean_test_score for r in rows],
        "std_test_score": [r.std_test_score for r in rows],
        "rank_test_score": [r.rank_test_score for r in rows],
        "mean_fit_time": [times[r.setting][0] for r in rows],
        "std_fit_time": [times[r.setting][1] for r in rows],
    }
    for name in sorted({k for p in table["params"] for k in p}):
        table[f"param_{name}"] = [p.get(name) for p in table["params"]]
    return {
        "best": best.setting,
        "best_params": str(dict(settings[best.setting].best_keys)),
        "best_score": best.mean_test_score,
        "cv_results": json.dumps(table),
    }
