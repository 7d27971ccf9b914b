"""Runs of a job file: {labelled, unlabelled} x {per row, per window}."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession, functions as F

from oddlog.detectors.base import Fitted, Shared, clean
from oddlog.detectors.thresholds import THRESHOLDS
from oddlog.functions.rows import is_anomaly, quoted, typed_fill
from oddlog.operators import evaluate as ev
from oddlog.operators.order import with_position
from oddlog.operators.windows import (
    WINDOW_DEFAULTS, flagged_positions, sliding_features, sliding_labels, window_count,
)
from oddlog.plans import config as cf, search as sr
from oddlog.plans.registry import DETECTORS, FEATURES, numeric_vector
from oddlog.session import hold
from oddlog.sources.sinks import append_metrics, metrics_frame, reset, write_anomalies
from oddlog.sources.tables import require_columns


def build_features(base: DataFrame, variant: cf.FeatureVariant, resources: dict) -> DataFrame:
    """``(row_id, features)``: the chains of a variant side by side in one plan."""
    names = [f"_f{i}" for i in range(len(variant.chains))]
    df = base.select(
        "row_id", *[typed_fill(base, column).alias(n) for n, (column, _) in zip(names, variant.chains)]
    )
    for name, (column, chain) in zip(names, variant.chains):
        # Vocabularies are kept per source column, whatever its place here.
        caches = resources.setdefault("_by_column", {}).setdefault(column, {})
        for step in chain:
            scope = {**{k: v for k, v in resources.items() if not str(k).startswith("_")}, "_vocabularies": caches}
            df = FEATURES[step.name](df, name, scope, **step.kwargs)
        df = numeric_vector(df, name)
    return VectorAssembler(inputCols=names, outputCol="features").transform(df).select("row_id", "features")


def _detector(estimator: cf.Estimator, setting: cf.Setting):
    """``fit(rows, shared) -> model`` for one setting, vector steps included."""
    params = [dict(p) for _, p in estimator.steps]
    for index, name, value in setting.params:
        params[index][name] = value
    params[-1].pop("contamination", None)
    detector = DETECTORS[estimator.steps[-1][0]](**params[-1])
    before = [(name, p) for (name, _), p in zip(estimator.steps[:-1], params[:-1])]

    def fit(rows: DataFrame, shared: Shared | None = None) -> Fitted:
        for name, kwargs in before:
            rows, shared = FEATURES[name](rows, "features", {}, **kwargs), None
        return detector.fit(rows, shared)

    return fit, detector.neighbours


def _scorings(estimator: cf.Estimator) -> list[tuple[tuple, list[int]]]:
    """Setting numbers by what changes the scores; contamination does not."""
    groups: dict[tuple, list[int]] = {}
    for number, setting in enumerate(estimator.settings):
        groups.setdefault(setting.params, []).append(number)
    return list(groups.items())


def _cuts(model: Fitted, estimator: cf.Estimator, numbers: list[int]) -> dict[int, float]:
    if estimator.threshold:
        cut = THRESHOLDS[estimator.threshold](model.train_scores)
        return {n: cut for n in numbers}
    shares = {n: float(estimator.settings[n].contamination) for n in numbers}
    by_share = model.cuts(sorted(set(shares.values())))
    return {n: by_share[s] for n, s in shares.items()}


@dataclass
class Unit:
    """What the detectors see: rows, or windows of rows."""

    features: DataFrame
    truth: DataFrame | None
    n_rows: int
    window: dict | None = None
    n_windows: int | None = None

    def row_flags(self, labels: DataFrame, by: tuple[str, ...]) -> DataFrame:
        """Flagged input rows ``(row_id, *by)``."""
        if self.window is None:
            return labels.filter("label = -1").select("row_id", *by)
        spread = labels.withColumnRenamed("row_id", "win_id")
        return flagged_positions(spread, self.window["size"], self.window["overlap"], "row_id", by)


@dataclass
class Result:
    """Metric rows and, per task that writes rows, the flagged rows."""

    metrics: list[dict] = field(default_factory=list)
    flagged: dict[tuple[str, str], DataFrame] = field(default_factory=dict)

    def frame(self, spark: SparkSession) -> DataFrame:
        return metrics_frame(spark, self.metrics)


def _windows(features: DataFrame, truth: DataFrame | None, n_rows: int, window: dict) -> Unit | None:
    count = window_count(n_rows, window["size"], window["overlap"])
    if count == 0:
        return None
    size, overlap = window["size"], window["overlap"]
    vectors = sliding_features(features, size, overlap, window["method"], pos="row_id").withColumnRenamed("win_id", "row_id")
    labels = None
    if truth is not None:
        labels = sliding_labels(truth, size, overlap, pos="row_id").withColumnRenamed("win_id", "row_id")
    return Unit(vectors, labels, n_rows, window, count)


class Runner:
    """One run over one table."""

    def __init__(self, table, jobs, mode, labels, order_by, window, folds, resources, results_path, target_path):
        self.jobs = cf.load_jobs(jobs)
        if mode not in ("point", "sequence"):
            raise ValueError(f"mode must be 'point' or 'sequence', not {mode!r}")
        self.mode, self.labelled = mode, labels is not None
        self.y, self.normal = cf.parse_labels(labels, self.labelled)
        require_columns(table, cf.required_columns(self.jobs, self.y), "the table")
        self.spark, self.window, self.folds = table.sparkSession, {**WINDOW_DEFAULTS, **(window or {})}, folds
        self.resources, self.results_path, self.target_path = dict(resources or {}), results_path, target_path
        if target_path is None:
            # No rows are written, so only what features, labels and order need is kept.
            table = table.select(*[quoted(c) for c in dict.fromkeys([*cf.required_columns(self.jobs, self.y), *order_by])])
        # Positions are the row ids of the whole run: windows, folds and joins use them.
        self.rows, self.n_rows = with_position(table, list(order_by), "row_id")
        self.result = Result()

    def run(self) -> Result:
        reset(self.spark, self.results_path, self.target_path)
        truth = None
        if self.labelled:
            truth = self.rows.select("row_id", is_anomaly(quoted(self.y), self.normal).alias("y"))
        for strategy, job in self.jobs.items():
            found = cf.estimators(job.get("estimators", {}))
            for variant in cf.feature_variants(job.get("features", {})) if found else []:
                done = len(self.result.metrics)
                self._variant(strategy, variant, found, truth)
                if self.results_path and len(self.result.metrics) > done:
                    append_metrics(self.spark, self.result.metrics[done:], self.results_path)
        return self.result

    def _variant(self, strategy: str, variant: cf.FeatureVariant, found: list, truth) -> None:
        features = build_features(self.rows, variant, self.resources)
        unit = Unit(features, truth, self.n_rows)
        if self.mode == "sequence":
            unit = _windows(features, truth, self.n_rows, self.window)
            if unit is None:
                return
        ready = hold(clean(unit.features))
        unit.features = ready
        if unit.truth is not None:
            unit.truth = hold(unit.truth)
        plans = [(e, _scorings(e)) for e in found]
        reach = max((_detector(e, e.settings[ns[0]])[1] for e, groups in plans for _, ns in groups), default=0)
        shared = Shared(ready, reach)
        # Plain estimators come before searched ones.
        for estimator, groups in sorted(plans, key=lambda p: self.labelled and p[0].searched):
            prefix = f"{strategy}__{variant.description}__"
            if self.labelled and estimator.searched:
                self._search(strategy, prefix, estimator, groups, unit, shared)
            else:
                self._plain(strategy, prefix, estimator, groups, unit, shared)
        shared.release()
        ready.unpersist()
        if unit.truth is not None:
            unit.truth.unpersist()

    def _plain(self, strategy, prefix, estimator, groups, unit, shared) -> None:
        scored, rows = [], {}
        for _, numbers in groups:
            fit, _ = _detector(estimator, estimator.settings[numbers[0]])
            model = fit(unit.features, shared)
            scores = hold(model.train_scores)
            model.train_scores = scores
            cuts = _cuts(model, estimator, numbers)
            names = {prefix + estimator.settings[n].description: c for n, c in cuts.items()}
            rows.update(self._measure(strategy, names, scores, unit))
            scored.append((scores, list(cuts.values()), names))
        for setting in estimator.settings:
            self._report(rows[prefix + setting.description])
        if self.labelled:
            for scores, _, names in scored:
                labels = ev.label_sets(scores, names).withColumnRenamed("variant", "task")
                for name in names:
                    self._write(strategy, name, unit.row_flags(labels.filter(F.col("task") == name), ()))
        else:
            self._vote(strategy, f"{prefix}{estimator.name}", [(s, c) for s, c, _ in scored], unit)
        for scores, _, _ in scored:
            scores.unpersist()

    def _vote(self, strategy, name, scored, unit) -> None:
        """One model writes its own rows; several write what they vote."""
        models = sum(len(c) for _, c in scored)
        voted = ev.vote_cuts(scored)
        if models > 1:
            name = f"{name}__voted"
            count = voted.agg(*ev.counts()).first()
            row = {"name": name, "strategy": strategy, **count.asDict(), "n_models": models}
            if unit.window is not None:
                row |= {
                    "n_seq_anomalies": count.n_anomalies,
                    "n_row_anomalies": unit.row_flags(voted, ()).count(),
                    "sequence_config": json.dumps(unit.window),
                }
            self._report(row)
        self._write(strategy, name, unit.row_flags(voted, ()))

    def _search(self, strategy, prefix, estimator, groups, unit, shared) -> None:
        n = unit.n_rows if unit.window is None else unit.n_windows
        folded = unit.features.withColumn("fold", sr.fold_of(F.col("row_id"), n, self.folds))
        scorings, reach = [], 0
        for _, numbers in groups:
            fit, neighbours = _detector(estimator, estimator.settings[numbers[0]])
            reach = max(reach, neighbours)
            scorings.append((fit, lambda model, numbers=numbers: _cuts(model, estimator, numbers)))
        found = sr.fold_scores(folded, unit.truth, scorings, self.folds, reach)
        found_rows = sr.ranked(self.spark, found).collect()
        told = sr.summary(found_rows, estimator.settings, sr.fit_times(found))
        best = told.pop("best")
        fit, _ = _detector(estimator, estimator.settings[best])
        model = fit(unit.features, shared)
        scores = hold(model.train_scores)
        model.train_scores = scores
        name = f"{prefix}{estimator.name}__grid"
        names = {name: _cuts(model, estimator, [best])[best]}
        self._report(self._measure(strategy, names, scores, unit)[name] | told)
        labels = ev.label_sets(scores, names)
        self._write(strategy, name, unit.row_flags(labels, ()))
        scores.unpersist()

    def _measure(self, strategy: str, names: dict[str, float], scores: DataFrame, unit: Unit) -> dict[str, dict]:
        """Metric rows of all cuts of one scoring, in one aggregate."""
        keep = ("row_id", "score")
        if unit.truth is not None:
            scores, keep = scores.join(unit.truth, "row_id"), (*keep, "y")
        labels = ev.label_sets(scores, names, keep)
        aggregates = [*ev.counts()]
        if self.labelled:
            aggregates += [*ev.confusion(), *ev.spread()]
        found = labels.groupBy("variant").agg(*aggregates)
        if self.labelled:
            found = ev.with_measures(found)
        covered = {}
        if unit.window is not None:
            flags = unit.row_flags(labels, ("variant",))
            covered = {r.variant: r["count"] for r in flags.groupBy("variant").count().collect()}
        rows = {}
        for r in found.collect():
            row = r.asDict()
            row = {"name": row.pop("variant"), "strategy": strategy, **row}
            if self.labelled:
                row["confusion_matrix"] = {
                    "true_negatives": row.pop("tn"), "false_positives": row.pop("fp"),
                    "false_negatives": row.pop("fn"), "true_positives": row.pop("tp"),
                }
            if unit.window is not None:
                row["sequence_config"] = json.dumps(unit.window)
                row["n_row_anomalies"] = covered.get(row["name"], 0)
                if not self.labelled:
                    row |= {"n_sequences": row["n_samples"], "n_seq_anomalies": row["n_anomalies"], "n_rows": unit.n_rows}
            rows[row["name"]] = row
        return rows

    def _report(self, row: dict) -> None:
        self.result.metrics.append(row)

    def _write(self, strategy: str, task: str, flagged: DataFrame) -> None:
        named = flagged.select("row_id", F.lit(strategy).alias("strategy"), F.lit(task).alias("task"))
        if self.target_path:
            write_anomalies(self.rows, named, self.target_path)
        else:
            self.result.flagged[(strategy, task)] = named


def run(
    table: DataFrame,
    jobs: str | dict,
    order_by: Sequence[str],
    mode: str = "point",
    labels: str | None = None,
    window: dict | None = None,
    folds: int = sr.DEFAULT_FOLDS,
    resources: dict | None = None,
    results_path: str | None = None,
    target_path: str | None = None,
) -> Result:
    """Run every job over ``table``.

    ``labels`` ("column:normal") makes it a benchmark: grids are searched and
    metrics compare with the labels. Without, grids are expanded and each
    estimator's models vote. ``order_by`` fixes the row order (last key
    unique). ``resources`` maps names used in the job file to word or vector
    tables.
    """
    return Runner(
        table, jobs, mode, labels, order_by, window, folds, resources, results_path, target_path
    ).run()
