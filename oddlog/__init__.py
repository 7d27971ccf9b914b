"""Outlier detection over text logs as Spark plans."""

import sys

from pyspark import cloudpickle

from oddlog.plans.config import build_info
from oddlog.plans.jobs import run
from oddlog.plans.registry import register_detector, register_feature, register_threshold
from oddlog.sources.tables import CsvSource, HitSource

__all__ = [
    "CsvSource", "HitSource", "build_info", "register_detector", "register_feature", "register_threshold", "run",
]

# Task functions travel with their helpers, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
