"""Imports every query module, which fills the registry."""

from __future__ import annotations

from tabsight.plans import (association, attribution, cleaning, derive, metrics, models, profiling,  # noqa: F401
                            rules, sources, splits)
from tabsight.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
