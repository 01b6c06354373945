"""Named queries with their checking SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.adapt import VIEWS, Tables

Plan = Callable[[Tables], DataFrame]


class Registry:
    """Queries of one module: plans over ``Tables`` and, where SQL can express them, DuckDB SQL over the same views."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
        def add(plan: Plan) -> Plan:
            self.queries[name] = lambda spark, sf_dir: plan(Tables(spark, sf_dir))
            if sql:
                self.oracles[name] = with_views(sql)
            return plan

        return add


def with_views(sql: str) -> str:
    """``sql`` with the definitions of the views that it names, and of those that these name, in front."""
    need: list[str] = []

    def visit(text: str) -> None:
        for v in VIEWS:
            if re.search(rf"\b{v}\b", text) and v not in need:
                visit(VIEWS[v])
                need.append(v)

    visit(sql)
    heads = ", ".join(f"{v} AS ({VIEWS[v]})" for v in need)
    m = re.match(r"\s*WITH( RECURSIVE)?\s", sql)
    if m:
        return f"WITH{m[1] or ''} {heads}{', ' if heads else ''}{sql[m.end():]}"
    return f"WITH {heads} {sql}" if heads else sql
