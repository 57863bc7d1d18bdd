"""Registered queries: a Spark plan and, where SQL can say the same, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]

REGISTRY: dict[str, tuple[Plan, str | None]] = {}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    def add(plan: Plan) -> Plan:
        assert name not in REGISTRY, name
        REGISTRY[name] = (plan, sql)
        return plan

    return add


def load() -> dict[str, tuple[Plan, str | None]]:
    from . import building, evaluation, flows, retrieval, runs, sourcing, tracing  # noqa: F401

    return REGISTRY
