"""Registered queries: each pairs an operator run on the driver tables with its SQL oracle."""

from catalog.registry import ORACLES, QUERIES, load_all

__all__ = ["ORACLES", "QUERIES", "load_all"]
