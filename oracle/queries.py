"""SQL for every registered query that plain SQL can express."""

from __future__ import annotations

import importlib

from oracle.compose import compose
from oracle.evidence import CTES

BODIES: dict[str, str] = {}

for module in ("findings_sql", "posture_sql", "correlation_sql", "lookup_sql", "drift_sql", "graph_sql", "wire_sql", "anomaly_sql", "stream_sql"):
    BODIES.update(importlib.import_module(f"oracle.{module}").BODIES)

ORACLE = {name: compose(body, CTES) for name, body in BODIES.items()}
