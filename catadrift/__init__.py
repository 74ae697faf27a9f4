"""Drift between two snapshots of a column catalog, on Spark."""

from catadrift.config import DriftConfig
from catadrift.plans.compare import Comparison, compare, compare_locations, compare_sheets
from catadrift.sources.inventory import read_inventory

__all__ = [
    "Comparison", "DriftConfig", "compare", "compare_locations", "compare_sheets", "read_inventory",
]
