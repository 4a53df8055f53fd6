"""All registered telemetry queries and the SQL each is held against."""

from __future__ import annotations

from fleetpulse import register
from fleetpulse.plans import compare_queries, evidence_queries, graph_queries, inspect_queries, leak_queries, loop_queries, side_queries, stream_queries, timeline_queries, verdict_queries  # noqa: F401  registers its queries

QUERIES = register.QUERIES
ORACLES = register.ORACLES
