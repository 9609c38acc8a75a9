"""All queries of the market-data operators and the SQL that checks them."""

from __future__ import annotations

from .plans.oracles import ORACLES
from .plans.queries import QUERIES

__all__ = ["ORACLES", "QUERIES"]
