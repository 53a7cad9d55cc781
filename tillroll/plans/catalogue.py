"""All registered queries."""

from tillroll.plans import analytics, cleaning, forecasts, functions, reports, views  # noqa: F401
from tillroll.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
