"""Queries over the test tables: ``QUERIES`` and their SQL, ``ORACLES``."""

from terrastack.plans import stored  # noqa: F401  adds its queries
from terrastack.plans.catalogue import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
