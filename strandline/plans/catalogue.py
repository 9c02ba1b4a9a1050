"""All trace and graph queries; importing the modules registers them."""

from __future__ import annotations

from strandline.plans import aggregate_plans, branch_plans, document_plans, enumeration_plans, event_plans, gate_plans, graph_plans, join_plans, resolution_plans, sequence_plans, source_plans, trace_plans, tracing_plans  # noqa: F401
from strandline.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
