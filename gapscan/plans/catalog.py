"""The registry of queries: name, DataFrame plan over the adapters, and SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from .adapters import Tables, with_adapters

MODULES = ("planning_queries", "run_queries", "gate_queries", "symbol_queries", "corpus_queries", "stream_queries")


class Catalog:
    def __init__(self):
        self.plans: dict[str, Callable[[Tables], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, plan: Callable[[Tables], DataFrame], sql: str | None = None) -> None:
        if name in self.plans:
            raise ValueError(f"{name} is registered twice")
        self.plans[name] = plan
        if sql:
            self.sql[name] = with_adapters(sql)


CATALOG = Catalog()


def _run(plan: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: plan(Tables(spark, sf_dir))


def load() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    for name in MODULES:
        import_module(f"gapscan.plans.{name}")
    return {k: _run(v) for k, v in CATALOG.plans.items()}, dict(CATALOG.sql)
