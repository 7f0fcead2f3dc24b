"""Where plans are registered: a name, a function of (spark, sf_dir), and the same question in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Plans by name. `views` are WITH-clauses that a plan's SQL may start from, by name, in order of dependence."""

    def __init__(self, views: dict[str, str] | None = None) -> None:
        self.plans: dict[str, Plan] = {}
        self.sql: dict[str, str] = {}
        self.views = views or {}

    def add(self, name: str, sql: str | None = None, uses: tuple[str, ...] = ()) -> Callable[[Plan], Plan]:
        def wrap(plan: Plan) -> Plan:
            if name in self.plans:
                raise ValueError(f"{name} is registered twice")
            self.plans[name] = plan
            if sql is not None:
                clauses = [f"{v} AS ({self.views[v]})" for v in self.views if v in uses]
                self.sql[name] = (f"WITH {', '.join(clauses)} " if clauses else "") + sql.strip()
            return plan

        return wrap
