"""Outlier detectors by the class name used in job files."""

from oddlog.detectors.density import Density
from oddlog.detectors.ecod import ECOD
from oddlog.detectors.hierarchy import Hierarchy
from oddlog.detectors.iforest import IForest
from oddlog.detectors.lunar import LUNAR
from oddlog.detectors.neighbours import KNN, LOF
from oddlog.detectors.recon import Reconstruction

__all__ = ["Density", "ECOD", "Hierarchy", "IForest", "KNN", "LOF", "LUNAR", "Reconstruction"]
