"""Query catalogue.  Importing this package registers every query."""
from __future__ import annotations

from mktlens.plans import q_entity, q_features, q_metrics, q_models, q_report, q_sources, q_streaming, q_windows  # noqa: F401
from mktlens.plans.registry import REGISTRY, Query

__all__ = ["REGISTRY", "Query", "queries", "oracle_sql"]


def queries():
    return {name: q.run for name, q in REGISTRY.queries.items()}


def oracle_sql():
    return {name: q.oracle() for name, q in REGISTRY.queries.items() if q.sql is not None}
