"""Job files to task lists: grids, descriptions, checks. Metadata only."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from itertools import product
from pathlib import Path
from typing import Any

# Fixed value: the share of anomalies a detector assumes when not told.
DEFAULT_CONTAMINATION = 0.1
_TUPLES = ("ngram_range",)


def class_name(dotted: str) -> str:
    """Steps and detectors go by the last part of their dotted name."""
    return dotted.rpartition(".")[2]


def load_jobs(source: str | dict) -> dict:
    """Job dict from a JSON file or a dict; range lists become tuples."""
    if isinstance(source, dict):
        jobs = source
    else:
        if not Path(source).exists():
            raise RuntimeError(f"job file not found: {source}")
        jobs = json.loads(Path(source).read_text(encoding="utf-8"))
    if not isinstance(jobs, dict):
        raise ValueError("a job file must hold a JSON object")

    def tupled(node: Any, name: str | None = None) -> Any:
        if name in _TUPLES and isinstance(node, list) and not any(isinstance(x, list) for x in node):
            return tuple(node)
        if isinstance(node, dict):
            return {k: tupled(v, k) for k, v in node.items()}
        return [tupled(x) for x in node] if isinstance(node, list) else node

    return tupled(jobs)


def expand_grid(grid: dict[str, list] | None) -> list[dict]:
    """All combinations, parameters in name order, the last one fastest."""
    names = sorted(grid or {})
    return [
        {n: tuple(v) if isinstance(v, list) else v for n, v in zip(names, values)}
        for values in product(*[grid[n] for n in names])
    ] if names else [{}]


def tag(params: dict) -> str:
    return "_".join(f"{k}={v}" for k, v in sorted(params.items()))


@dataclass(frozen=True)
class Step:
    """One transformer of a column chain."""

    name: str
    params: tuple

    @property
    def kwargs(self) -> dict:
        return dict(self.params)


def _step(name: str, params: dict) -> Step:
    return Step(name, tuple(sorted(params.items(), key=lambda kv: kv[0])))


# Fixed values of the job-file contract: steps added around a known one, as ("before" | "after", step).
AUTO_STEPS = {
    "CountVectorizer": [("after", "densify")],
    "HashingVectorizer": [("after", "densify")],
    "TruncatedSVD": [("before", "nan_to_num")],
}


@dataclass(frozen=True)
class FeatureVariant:
    """A chain per column and the text that names the combination."""

    description: str
    chains: tuple[tuple[str, tuple[Step, ...]], ...]


def feature_variants(features: dict[str, dict]) -> list[FeatureVariant]:
    """Every combination of the step grids within and across columns."""
    per_column = []
    for column, steps in features.items():
        chains: list[tuple[list[str], list[Step]]] = [([], [])]
        for dotted, spec in steps.items():
            name = class_name(dotted)
            around = AUTO_STEPS.get(name, [])
            grown = []
            for (words, chain), combo in product(chains, expand_grid(spec.get("grid"))):
                this = _step(name, {**spec.get("params", {}), **combo})
                before = [_step(s, {}) for place, s in around if place == "before"]
                after = [_step(s, {}) for place, s in around if place == "after"]
                word = f"{name}({tag(combo)})" if combo else name
                grown.append((words + [word], chain + before + [this] + after))
            chains = grown
        per_column.append([(f"{column}__{'__'.join(words)}", column, tuple(chain)) for words, chain in chains])
    if not per_column:
        return []
    return [
        FeatureVariant(" + ".join(d for d, _, _ in combo), tuple((c, chain) for _, c, chain in combo))
        for combo in product(*per_column)
    ]


@dataclass(frozen=True)
class Setting:
    """One detector setting: everything but the contamination share."""

    description: str
    params: tuple  # ((step index, name, value), ...)
    contamination: float | None
    best_keys: tuple  # ((full parameter name, value), ...) as reported


@dataclass
class Estimator:
    """A detector (last step) with optional vector steps before it."""

    name: str
    steps: list[tuple[str, dict]]
    grid: dict[str, list]
    threshold: str | None = None
    settings: list[Setting] = field(default_factory=list)

    @property
    def searched(self) -> bool:
        return bool(self.grid)


def estimators(spec: dict[str, list[dict]]) -> list[Estimator]:
    found = []
    for name, steps in spec.items():
        parts, grid, threshold = [], {}, None
        for index, step in enumerate(steps):
            label = f"{name}_{index}" if len(steps) > 1 else name
            own_grid = dict(step.get("grid", {}))
            for param, dotted in step.get("threshold", {}).items():
                if param != "contamination":
                    raise ValueError(f"{name}: only contamination takes a threshold, not {param!r}")
                threshold = class_name(dotted)
                own_grid.pop(param, None)
            parts.append((class_name(step["class"]), dict(step.get("params", {}))))
            grid.update({f"{label}__{k}": v for k, v in own_grid.items()})
        this = Estimator(name, parts, grid, threshold)
        labels = [f"{name}_{i}" if len(steps) > 1 else name for i in range(len(steps))]
        for combo in expand_grid(grid):
            params, contamination = [], parts[-1][1].get("contamination", DEFAULT_CONTAMINATION)
            for full, value in combo.items():
                label, _, param = full.partition("__")
                index = labels.index(label)
                if param == "contamination" and index == len(steps) - 1:
                    contamination = value
                else:
                    params.append((index, param, value))
            words = "_".join(f"{k.split('__')[-1]}={v}" for k, v in sorted(combo.items()))
            this.settings.append(Setting(
                f"{name}__{words}" if words else name, tuple(params),
                None if threshold else contamination, tuple(combo.items()),
            ))
        found.append(this)
    return found


def required_columns(jobs: dict, label: str | None = None) -> list[str]:
    columns = {c for job in jobs.values() for c in job.get("features", {})}
    return sorted(columns | ({label} if label else set()))


def parse_labels(labels: str | None, labelled: bool) -> tuple[str | None, str | None]:
    """``"column:normal"`` split at the first colon; wanted exactly when labelled."""
    if labelled and not labels:
        raise ValueError("a labelled run needs labels, e.g. 'class:Normal'")
    if not labelled and labels:
        raise ValueError(f"an unlabelled run takes no labels (got {labels!r})")
    if not labelled:
        return None, None
    column, colon, normal = labels.partition(":")
    if not colon:
        raise ValueError(f"labels must be 'column:normal_value' (got {labels!r})")
    return column, normal


def task_total(jobs: dict, labelled: bool) -> int:
    """Feature variants times tasks; a searched estimator is one labelled task."""
    total = 0
    for job in jobs.values():
        found = estimators(job.get("estimators", {}))
        tasks = sum(1 if labelled and e.searched else len(e.settings) for e in found)
        total += len(feature_variants(job.get("features", {}))) * tasks
    return total


def build_info(jobs: dict, source: str, labels: str | None = None) -> dict:
    """What a run will do, before it starts."""
    column, normal = parse_labels(labels, labels is not None)
    return {
        "source": source,
        "required_columns": required_columns(jobs, column),
        "strategies": list(jobs),
        "total_tasks": task_total(jobs, labels is not None),
        "labeled": labels is not None,
        "y_config": [column, normal] if labels else None,
    }
