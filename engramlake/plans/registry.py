"""All registered queries of the core with their SQL."""

from __future__ import annotations

from .oracle import ORACLES
from .queries import QUERIES

__all__ = ["ORACLES", "QUERIES"]
