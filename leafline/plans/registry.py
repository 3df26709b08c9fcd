"""All queries of the core and their SQL."""

from __future__ import annotations

from leafline.plans import further, more
from leafline.plans.oracles import ORACLES
from leafline.plans.queries import QUERIES

__all__ = ["ORACLES", "QUERIES", "further", "more"]
