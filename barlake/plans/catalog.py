"""All registered queries."""

from __future__ import annotations

from barlake.plans import company_queries, crosssection_queries, file_queries, indicator_queries, live_queries, model_queries, signal_queries, state_queries  # noqa: F401
from barlake.plans.registry import REGISTRY

__all__ = ["REGISTRY"]
