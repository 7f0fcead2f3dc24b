"""Ready plans over the tables, and the same questions in SQL."""

from __future__ import annotations

from . import document_plans, forecast_plans, index_plans, other_plans, planner_plans, press_plans, printed_plans, series_plans, source_plans, stream_plans, visit_plans
from .registry import Plan

_ALL = (visit_plans, series_plans, forecast_plans, document_plans, press_plans, planner_plans, stream_plans, other_plans, source_plans, index_plans, printed_plans)


def queries() -> dict[str, Plan]:
    return {name: plan for m in _ALL for name, plan in m.R.plans.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _ALL for name, sql in m.R.sql.items()}
