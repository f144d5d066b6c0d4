"""All registered queries."""

from __future__ import annotations

import importlib

from postern.plans.base import QUERIES, query

__all__ = ["QUERIES", "query"]

for module in ("findings", "posture", "correlation", "lookup", "drift", "graph", "wire", "anomaly", "stream"):
    importlib.import_module(f"postern.plans.{module}_plans")
