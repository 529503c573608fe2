"""Intermediate tables in the folder that all executors share."""

from tastegraph.plans.lineage import written

__all__ = ["written"]
