"""Queries over the driver tables, each with SQL for comparison where SQL can say it."""

from tidemark.plans import bodies, bonds, funds, histories, instruments, landing, lineages, markets, portfolios, rates, registers, registry, screening, statements, stores, warehouse  # noqa: F401
from tidemark.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
