"""Registered queries: a name, a plan over the contest views, and the same as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rallyframe.sources.views import BASE_SQL, Contest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
PLANS: dict[str, Callable[[Contest], DataFrame]] = {}


def query(name: str, plan: Callable[[Contest], DataFrame], sql: str | None = None, base: bool = True) -> None:
    """Register ``plan``; ``sql`` follows the views' WITH clause (further CTEs begin with a comma) unless ``base`` is false."""
    if name in QUERIES:
        raise ValueError(f"query {name} is registered twice")
    PLANS[name] = plan
    QUERIES[name] = lambda spark, sf_dir: plan(Contest(spark, sf_dir))
    if sql is not None:
        ORACLES[name] = f"{BASE_SQL}{sql}" if base else sql
