"""Imports every query module, so that the registry is complete."""

from tickloom.queries import (backtests, calendars, chains, cleaning, forecasts, panels,  # noqa: F401
                              questions, refreshes, sources, statistics, streams)
from tickloom.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
