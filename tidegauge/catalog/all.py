"""Importing this module registers every query."""

from tidegauge.catalog import answers, models, scores, series, tables  # noqa: F401
from tidegauge.catalog.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
