"""Queries over the given tables that exercise every operator, with SQL equivalents."""

from workloads import answers, matching, records, trees, vectors  # noqa: F401
from workloads.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
