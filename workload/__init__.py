"""Queries over the driver tables: every operator applied to a whole table, with its SQL."""

from workload import explaining, forests, preparing, results, saturated, tables  # noqa: F401  (they register)
from workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
